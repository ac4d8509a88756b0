"""What the operators share: reading tables, kept intermediates, batches of text."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from agora.operators.pinning import Pinned, pin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(frame: DataFrame) -> Pinned:
    """``frame`` computed into the shared folder, so that lineage ends there."""
    return pin(frame, "snappy")


def fresh_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or with underscores before it until no column has that name."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes, so that long texts do not pile up.

    A single row is never cut, however long.
    """
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * limit // max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


_tables: dict[Hashable, object] = {}


def worker_table[T](key: Hashable, make: Callable[[], T]) -> T:
    """The tables ``key`` of this Python worker, made once and kept for its next tasks of that kind."""
    if key not in _tables:
        _tables[key] = make()
    return _tables[key]


def release() -> None:
    """Drop the tables this worker keeps and give its free memory back to the system.

    Workers outlive their tasks, so operators that need memory do this first.
    """
    _tables.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal ``keys``, from rows sorted by them.

    Several small groups come together, about ``least`` rows at a time.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held)
        starts = group_starts(whole, keys)
        cut = int(starts[-1])
        if cut:
            yield whole.slice(0, cut)
        rest = whole.slice(cut).combine_chunks()
        held, rows = rest.to_batches(), 0 if cut else rest.num_rows
        if not cut:
            least *= 2
    if held:
        yield pa.Table.from_batches(held)


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """The positions where a new group of equal neighbours begins."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
