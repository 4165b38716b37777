"""Groups of rows inside a sorted partition, streamed to a Python function in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm.shared import lean


def streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups; batches come sorted by the keys (whole numbers), and a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy() for k in keys]
        starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if held:
            last = held[-1]
            if any(last[k][-1].as_py() != c[0].item() for k, c in zip(keys, cols)):
                yield pa.Table.from_batches(held)
                held = []
        at = 0
        for s in starts:
            held.append(batch.slice(at, s - at))
            yield pa.Table.from_batches(held)
            held, at = [], s
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict | None], schema: str, arrow: pa.Schema, rows: int = 1 << 16) -> DataFrame:
    """fn over each group of df by its keys; fn returns columns or None. Groups are expected to be of bounded size."""

    def run(batches):
        out, n = [], 0
        for group in streamed(batches, keys):
            got = fn(group)
            if got:
                out.append(pa.RecordBatch.from_pydict(got, arrow))
                n += out[-1].num_rows
            if n >= rows:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, n = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run, None), schema)
