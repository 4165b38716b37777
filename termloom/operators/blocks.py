"""Relevance models of one block of queries in numpy: the JVM deals queries, the documents they need and the vocabulary to blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms of a query that are weighed at once.
WIDE = 16_384


def column(table: pa.Table, name: str) -> pa.Array:
    held = table[name].combine_chunks()
    return held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)


def lists(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, one after the other, and where each list begins and the last ends."""
    held = column(table, name)
    return held.flatten(), np.append(0, np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False)))


def told_apart(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, ...]:
    """Queries, documents and vocabulary of a block, or () where it lacks one of them."""
    kinds = {"query": [], "docid": [], "term": []}
    for batch in batches:
        table = pa.table(batch)
        for key, own in kinds.items():
            asked = pc.is_valid(table[key])
            if pc.any(asked).as_py():
                own.append(table.filter(asked))
    return tuple(map(pa.concat_tables, kinds.values())) if all(kinds.values()) else ()


def ranges(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of documents `at`, and how many each has."""
    sizes = first[at + 1] - first[at]
    begins = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(first[at] - begins, sizes), sizes


def weighed(total: float, lam: float, floor: float, docid: pa.DataType, query: pa.DataType, wide: int = WIDE):
    """A function of Arrow batches that gives docid, query, terms, weights, doc_score, times for each clicked document of each query.

    Rows with a query hold what it asks (ids, null for terms that the collection lacks, and qtfs), its feedback (fed, scores) and clicks
    (clicked, times). Rows with a docid hold a document: ids and frequencies of its terms that matter, and dl. Rows with a term
    hold id and cf, where id counts from 0. See `relevance` for the formula.
    """
    schema = pa.schema([("docid", docid), ("query", query), ("terms", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), ("doc_score", pa.float64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = told_apart(batches)
        if not held:
            return
        queries, docs, vocabulary = held
        del held
        id_of = vocabulary["id"].to_numpy()
        order = np.argsort(id_of)
        terms, cf = column(vocabulary, "term").take(pa.array(order)), vocabulary["cf"].to_numpy()[order].astype(np.float64)
        bg = cf / total
        names = column(docs, "docid")
        ids, first = lists(docs, "ids")
        ids = ids.to_numpy(zero_copy_only=False)
        extra = lam * (lists(docs, "tfs")[0].to_numpy(zero_copy_only=False) / np.repeat(docs["dl"].to_numpy(), np.diff(first)) - bg[ids])
        del docs
        asked, asked_first = lists(queries, "ids")
        asked, qtf = pc.fill_null(asked, -1).to_numpy(zero_copy_only=False), lists(queries, "qtfs")[0].to_numpy(zero_copy_only=False).astype(np.float64)
        fed, fed_first = lists(queries, "fed")
        clicked, clicked_first = lists(queries, "clicked")
        scores, times = (lists(queries, c)[0].to_numpy(zero_copy_only=False) for c in ("scores", "times"))
        fed_at = pc.fill_null(pc.index_in(fed, value_set=names), -1).to_numpy(zero_copy_only=False)
        clicked_at = pc.fill_null(pc.index_in(clicked, value_set=names), -1).to_numpy(zero_copy_only=False)
        texts = column(queries, "query")
        score, place, slot = np.zeros(len(names)), np.full(len(cf), -1), np.full(len(cf), -1)
        out, n_out = [], 0
        for i in range(len(texts)):
            f = fed_at[fed_first[i] : fed_first[i + 1]]
            known = f >= 0
            f, s = f[known], scores[fed_first[i] : fed_first[i + 1]][known]
            c = clicked_at[clicked_first[i] : clicked_first[i + 1]]
            own = times[clicked_first[i] : clicked_first[i + 1]][c >= 0]
            c = c[c >= 0]
            t, k = (x[asked_first[i] : asked_first[i + 1]] for x in (asked, qtf))
            if not (len(f) and len(c) and len(t)):
                continue
            at, sizes = ranges(first, c)
            of = ids[at]
            wanted = np.unique(of)
            place[wanted], slot[t[t >= 0]] = np.arange(len(wanted)), np.flatnonzero(t >= 0)
            log_p = scored(len(f), wanted, t, k, bg, 0.5 / total, floor, *entries(first, ids, extra, f), place, slot, wide)
            begins = np.cumsum(sizes) - sizes
            share = cf[of] / np.repeat(np.add.reduceat(cf[of], begins), sizes)
            score[f] = s
            out.append((np.full(len(c), i), c, sizes, of, np.log(share) + log_p[place[of]], score[c], own))
            score[f], place[wanted], slot[t[t >= 0]] = 0.0, -1, -1
            n_out += len(of)
            if n_out >= 500_000:
                yield packed(out, texts, names, terms, schema)
                out, n_out = [], 0
        if out:
            yield packed(out, texts, names, terms, schema)

    return run


def entries(first: np.ndarray, ids: np.ndarray, extra: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and how far above the background of every entry of the documents f."""
    at, sizes = ranges(first, f)
    return np.repeat(np.arange(len(f)), sizes), ids[at], extra[at]


def scored(n: int, wanted, t, qtf, bg, half: float, floor: float, row, term, extra, place, slot, wide: int) -> np.ndarray:
    """log_p of each wanted term for a query that asks t: see `relevance`."""
    bg_t = np.where(t >= 0, bg[t], half)
    hit = slot[term] >= 0
    asked = np.zeros((n, len(t)))
    asked[row[hit], slot[term[hit]]] = extra[hit]
    b, cell = asked.sum(axis=0), place[term]
    out = []
    for begin in range(0, len(wanted), wide):
        some = wanted[begin : begin + wide]
        held = (cell >= begin) & (cell < begin + len(some))
        above = np.zeros((n, len(some)))
        above[row[held], cell[held] - begin] = extra[held]
        a, bg_w = above.sum(axis=0), bg[some]
        both = np.outer(bg_w, n * bg_t + b) + np.outer(a, bg_t) + above.T @ asked
        out.append(np.log(np.maximum(both / (n * bg_w + a)[:, None], floor)) @ qtf)
    return np.concatenate(out)


def packed(out: list, texts: pa.Array, names: pa.Array, terms: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    i, c, sizes, of, weights, scores, times = (np.concatenate(x) for x in zip(*out))
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    words = pa.ListArray.from_arrays(offsets, terms.take(pa.array(of)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(c)), texts.take(pa.array(i)), words, pa.ListArray.from_arrays(offsets, pa.array(weights)), pa.array(scores), pa.array(times)], schema=schema)
