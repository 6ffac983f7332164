"""Functions over parts of a table, where no expression says it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def by_sequence(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, partitions: int | None = None) -> DataFrame:
    """f over pieces of each partition, an Arrow batch at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(f, batches)

    return (df.repartition(partitions) if partitions else df).mapInPandas(run, schema)


def _differs(column: pa.Array) -> pa.Array:
    """Whether each value but the first differs from the one before; missing values are alike."""
    now, was = column[1:], column[:-1]
    return pc.or_(pc.fill_null(pc.not_equal(now, was), False), pc.not_equal(pc.is_null(now), pc.is_null(was)))


def pieces(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows): each batch cut where the key changes."""
    for b in batches:
        if not b.num_rows:
            continue
        cuts = {0, b.num_rows}
        for k in keys:
            cuts.update(i + 1 for i in pc.indices_nonzero(_differs(b.column(k))).to_pylist())
        ends = sorted(cuts)
        for i, j in zip(ends, ends[1:], strict=False):
            yield tuple(b.column(k)[i].as_py() for k in keys), b.slice(i, j - i)


def by_key(df: DataFrame, keys: str | tuple[str, ...], f: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """f(key, batches) of each key, with its rows in an order, as Arrow batches one after the other.

    Rows are dealt and sorted by key, and a key's batches pass through f as they come and go as f yields, so a task
    holds a batch of a key, however many rows that has. f need not read all; a missing key is a key.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groupby(pieces(batches, keys), lambda x: x[0]):
            yield from f(key, (rows for _, rows in own))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def streamed(df: DataFrame) -> Iterator:
    """Rows one partition after the other, so that the driver holds one partition at most."""
    return df.toLocalIterator(prefetchPartitions=True)
