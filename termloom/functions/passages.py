"""Words and runs of words as numbers, in numpy: which texts may hold which passages, and which terms are wanted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.functions import text as T

#: Bits of a filter of keys; what has a bit may be wanted, what has none isn't.
BITS = 1 << 23

#: A number for each byte, and an odd base with its inverse modulo 2 ** 64.
VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inner_runs(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """row, key of each run of `width` words between single spaces that has a space at both ends; equal runs have equal keys."""
    data, begins = T.bytes_of(texts)
    spaces = np.flatnonzero(data == 32)
    a, z = spaces[:-width], spaces[width:]
    rows = np.searchsorted(begins, a, "right") - 1
    whole = z < begins[rows + 1]
    a, z, rows = a[whole] + 1, z[whole], rows[whole]
    return rows, span_keys(data, a, z)


def span_keys(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A number for the bytes from each a to each z; equal bytes have equal ones."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    return ((sums[z] - sums[a]) * powers(INVERSE, len(data) + 1)[a]).view(np.int64)


def word_keys(words: pa.Array) -> np.ndarray:
    data, begins = T.bytes_of(words)
    return span_keys(data, begins[:-1], begins[1:])


def numbers(keys: pa.Array) -> np.ndarray:
    return keys.to_numpy(zero_copy_only=False)


def bit(keys: np.ndarray) -> np.ndarray:
    """A key's bit in the filter."""
    return ((keys.view(np.uint64) * np.uint64(BASE)) >> np.uint64(41)).astype(np.int64)


def with_first_run(width: int):
    """A function of Arrow batches that adds key, the first inner run of column passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = inner_runs(batch["passage"], width)
            row, first = np.unique(rows, return_index=True)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(keys[first])], names=[*batch.schema.names, "key"])

    return run


def key_filter(rows: DataFrame, column: str, keys_of: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """A bit for the key of each value of a column, made where the rows lie; a partition sends BITS / 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BITS, bool)
        for batch in batches:
            held[bit(keys_of(batch[column]))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()])], names=["bits"])

    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.select(column).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = bit(keys)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0


def wanted_words(terms: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """Which of an array of words may be in column term: all that are, and few others."""
    bits = key_filter(terms, "term", word_keys)
    return lambda words: has_bit(bits, word_keys(words))


def with_known_runs(width: int, bits: np.ndarray):
    """A function of Arrow batches docid, text that gives docid, text, keys of the texts whose inner runs have a bit, each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in T.pieces(batch["text"]):
                part = batch.slice(a, z - a)
                rows, keys = inner_runs(part["text"], width)
                known = has_bit(bits, keys)
                rows, keys = rows[known], keys[known]
                if not len(rows):
                    continue
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                new = np.append(True, (np.diff(rows) != 0) | (np.diff(keys) != 0))
                rows, keys = rows[new], keys[new]
                row, first = np.unique(rows, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(keys))
                held = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([held["docid"], held["text"], lists], names=["docid", "text", "keys"])

    return run
