"""Applying a batch to a stored table by rewriting only the buckets it can change.

The keys of a batch say in which buckets its rows lie.  The job of ``plans.merge`` sees
those buckets as the table, so that what it returns is what they hold afterwards; they
are then replaced, and the files of all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators.joins import keep_found
from agora.operators.pinning import Pinned, pin
from agora.plans.merge import Merged
from agora.schema import Layout, Tables
from agora.sources.stored import (
    BUCKET,
    BUCKET_KEY,
    INDEX,
    LOOKUP_COLUMN,
    MONTH,
    MONTHS,
    bucket_of,
    conform,
    month_of,
    with_stored,
    write_parts,
)

Job = Callable[[Tables, DataFrame], Merged]


@dataclass(frozen=True)
class InPlace:
    """The tables as they are stored after a batch, and what became of its requests."""

    tables: Tables
    outcomes: DataFrame


def _threads_of(layout: Layout, ids: DataFrame) -> DataFrame:
    """(bucket) of the posts that comments with these ids are on."""
    keyed = ids.dropna().distinct().withColumn(BUCKET, bucket_of(F.col("id"), layout.buckets))
    named = pin(keyed)
    places = F.broadcast(named.frame.select(BUCKET).distinct())
    near = layout.index.join(places, BUCKET, "left_semi").drop(BUCKET)
    found = keep_found(near, Pinned(named.frame.select("id"), named.rows), ["id"])
    return found.select(bucket_of(F.col("post_id"), layout.buckets).alias(BUCKET))


def touched_buckets(layout: Layout, name: str, batch: DataFrame) -> Pinned:
    """The distinct buckets of the rows that a batch names; no more than the table has.

    Comments lie with their post: those named by id, or as a parent, are looked up in
    the index.
    """
    key = BUCKET_KEY[name]
    found = []
    if key in batch.columns:
        found.append(batch.select(bucket_of(F.col(key), layout.buckets).alias(BUCKET)))
    if name == "comments":
        found += [_threads_of(layout, batch.select(F.col(c).alias("id"))) for c in ("id", "parent_id") if c in batch.columns]
    if not found:
        raise ValueError(f"the batch does not say which rows of {name} it is about")
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return pin(every.distinct())


def _drop_emptied(spark: SparkSession, parts: Pinned, rows: DataFrame, part: str, path: str) -> None:
    """Delete the folders of ``parts`` that have no row left, since overwriting does not."""
    gone = parts.frame.join(F.broadcast(rows.select(part).distinct()), part, "left_anti")
    for row in gone.collect():  # no more than the table has buckets
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}={row[part]}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _refresh(stored: DataFrame, changed: DataFrame, part: str, order: str, path: str) -> None:
    """Put changed rows, known by id, into the folders of a stored copy that they lie in."""
    parts = pin(changed.select(part).distinct())
    in_parts = stored.join(F.broadcast(parts.frame), part, "left_semi")
    stays = in_parts.join(changed.select("id"), "id", "left_anti")
    rows = pin(stays.unionByName(changed.select(*stays.columns)))
    if rows.rows:
        write_parts(rows.frame, part, order, path, "overwrite")


def apply_in_place(tables: Tables, name: str, path: str, batch: DataFrame, job: Job) -> InPlace:
    """``job(tables, batch)`` on the table ``name`` stored in buckets below ``path``.

    ``job`` must change only rows that the batch names by the bucket key of the table,
    or comments by id.  Users are not for this: a name must be unique among them all.

    The new rows are computed into the shared folder before anything is replaced, and the
    buckets of one folder are replaced when all their files are written.  The index or
    copy, the table, and the deletion of emptied buckets are three steps: a driver that
    dies between them leaves them apart, and the table must be written again.  Readers
    from before must read again.  A batch without requests changes nothing.
    """
    if name == "users":
        raise ValueError("names of users are unique across buckets")
    layout = tables.layout
    if layout is None or not layout.knows(name):
        raise ValueError(f"{name} is not stored in buckets")
    spark = batch.sparkSession
    buckets = touched_buckets(layout, name, batch)
    near = layout.frames[name].join(F.broadcast(buckets.frame), BUCKET, "left_semi").drop(BUCKET)
    merged = job(tables.with_(**{name: near}), batch)
    key = bucket_of(F.col(BUCKET_KEY[name]), layout.buckets)
    rows = pin(conform(merged.table, name).withColumn(BUCKET, key))
    outcomes = pin(merged.outcomes)

    if name in ("posts", "comments"):
        ids = pin(batch.select("id").dropna().distinct())
        copied = rows.frame.drop(BUCKET) if name == "posts" else rows.frame.select("id", "post_id")
        changed = pin(keep_found(copied, ids, ["id"])).frame
        if name == "posts":
            _refresh(layout.months, changed.withColumn(MONTH, month_of("created_at")), MONTH, "created_at", f"{path}/{MONTHS}")
        else:
            keyed = changed.select("id", "post_id", bucket_of(F.col("id"), layout.buckets).alias(BUCKET))
            _refresh(layout.index, keyed, BUCKET, "id", f"{path}/{INDEX}")
    if rows.rows:
        write_parts(rows.frame, BUCKET, LOOKUP_COLUMN[name], f"{path}/{name}", "overwrite")
    _drop_emptied(spark, buckets, rows.frame, BUCKET, f"{path}/{name}")
    return InPlace(with_stored(spark, tables, name, path), outcomes.frame)
