"""Exact top-k search of one shard of an index in numpy: the JVM deals postings, lengths and queries to shards, this scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that may round alike when the final order is made.
NEAR = 2e-9


def filled(batches: Iterator[pa.RecordBatch]) -> tuple[tuple, tuple, tuple]:
    """Queries (q, t, w), postings (docid, t, values) and lengths (docid, values) of a shard, told apart by which columns are null."""
    queries, posts, lengths = [], [], []
    for batch in batches:
        table = pa.table(batch)
        asked, no_term = pc.is_valid(table["q"]), pc.is_null(table["t"])
        if pc.any(asked).as_py():
            queries.append(table.filter(asked).select(["q", "t", "w"]))
            table, no_term = table.filter(pc.invert(asked)), no_term.filter(pc.invert(asked))
        posts.append(table.filter(pc.invert(no_term)).select(["docid", "t", "values"]))
        lengths.append(table.filter(no_term).select(["docid", "values"]))
    empty = [x for x in (queries, posts, lengths) if not x or not sum(p.num_rows for p in x)]
    return () if empty else tuple(pa.concat_tables(x).combine_chunks() for x in (queries, posts, lengths))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length, a row for each list."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Lists:
    """Postings of a shard by term: documents in order, what each adds per unit of weight, and the most that any adds."""

    def __init__(self, t: np.ndarray, doc: np.ndarray, part: np.ndarray, n_docs: int):
        self.terms, first = np.unique(t, return_index=True)  # t is sorted
        self.first, self.last = first, np.append(first[1:], len(t))
        self.doc, self.part, self.most = doc, part, np.maximum.reduceat(part, first)
        self.score = np.zeros(n_docs)

    def best(self, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that may be among a query's k best; at: places of its terms, weights: of each.

        Terms that can add most come first. Once the k-th best sum so far is above all that the terms left can add, only documents
        that have a chance are looked up in their lists.
        """
        bound = weights * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, weights, bound = at[order].tolist(), weights[order].tolist(), bound[order]
        left = np.append(np.cumsum(bound[::-1])[::-1], 0.0).tolist()
        score, seen, docs = self.score, [], None
        n_seen = 0
        for i, (p, w) in enumerate(zip(at, weights)):
            a, z = self.first[p], self.last[p]
            if docs is None:
                listed = self.doc[a:z]
                before = score[listed]
                new = listed[before == 0.0]
                score[listed] = before + w * self.part[a:z]
                seen.append(new)
                n_seen += len(new)
                if n_seen < k or i + 1 == len(at) or left[0] - left[i + 1] < left[i + 1]:  # no sum can be above all that's left yet
                    continue
                now = np.concatenate(seen)
                seen = [now]
                sums = score[now]
                if sums.max() <= left[i + 1]:
                    continue
                floor = np.partition(sums, n_seen - k)[n_seen - k]
                if floor > left[i + 1] + NEAR:
                    docs = now[sums + left[i + 1] >= floor - NEAR]
            else:
                place = a + np.searchsorted(self.doc[a:z], docs)
                held = place < z
                place[~held] = a
                held &= self.doc[place] == docs
                score[docs[held]] += w * self.part[place[held]]
        touched = np.concatenate(seen)
        docs = touched if docs is None else docs
        sums = score[docs]
        score[touched] = 0.0
        if len(docs) > k:
            floor = np.partition(sums, len(docs) - k)[len(docs) - k]
            held = sums >= floor - NEAR
            docs, sums = docs[held], sums[held]
        return docs, sums


def first_of_equals(sums: np.ndarray, nth: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k, by nth, of each run of equal sums: k others stand before the rest in any order by score and docid."""
    order = np.lexsort((nth, -sums))
    begins = np.flatnonzero(np.append(True, np.diff(sums[order]) != 0))
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[place < k]


def searched(means: list[float], k1: float, b: float, k: int, docid: pa.DataType):
    """A function of Arrow batches q, docid, t, w, values that gives q, g, docid, score: what may be among each query's k best in index g.

    means: the mean length of each index. Rows with q are queries' terms and weights; rows with t alone are postings, with the
    frequency in each index; rows without either are documents, with their lengths.
    """
    schema = pa.schema([("q", pa.int64()), ("g", pa.int32()), ("docid", docid), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filled(batches)
        if not held:
            return
        queries, posts, lengths = held
        names = lengths["docid"].combine_chunks()
        doc = pc.index_in(posts["docid"], value_set=names).to_numpy(zero_copy_only=False)
        t, tf = posts["t"].to_numpy(), matrix(posts["values"])
        order = np.lexsort((doc, t))
        t, doc, tf = t[order], doc[order].astype(np.int64), tf[order]
        long = matrix(lengths["values"])
        nth = np.empty(len(names), np.int64)
        nth[pc.sort_indices(pc.cast(names, pa.string())).to_numpy()] = np.arange(len(names))
        del held, posts, lengths, order
        q, asked, w = (queries[c].to_numpy() for c in ("q", "t", "w"))
        for g, mean in enumerate(means):
            f = tf[:, g].astype(np.float64)
            lists = Lists(t, doc, f / (f + k1 * (1 - b + b * long[doc, g] / mean)), len(names))
            at = np.searchsorted(lists.terms, asked)
            at[at == len(lists.terms)] = 0
            known = np.flatnonzero(lists.terms[at] == asked)
            known = known[np.argsort(q[known], kind="stable")]
            ids, begins = np.unique(q[known], return_index=True)
            out, n = [], 0
            for i, own in zip(ids.tolist(), np.split(known, begins[1:])):
                docs, sums = lists.best(at[own], w[own], k)
                if len(docs) > k:
                    few = first_of_equals(sums, nth[docs], k)
                    docs, sums = docs[few], sums[few]
                out.append((i, docs, sums))
                n += len(docs)
                if n >= 50_000:
                    yield packed(out, g, names, schema)
                    out, n = [], 0
            if out:
                yield packed(out, g, names, schema)

    return run


def packed(out: list, g: int, names: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    sizes = [len(d) for _, d, _ in out]
    q = np.repeat(np.array([i for i, _, _ in out], np.int64), sizes)
    docs, sums = (np.concatenate([x[j] for x in out]) for j in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), g, np.int32)), names.take(pa.array(docs)), pa.array(sums)], schema=schema)
