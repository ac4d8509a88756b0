"""Reading and writing the six tables as Parquet."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.operators.pinning import CODEC, shuffles_dropped
from agora.schema import SCHEMAS, Layout, Tables

# Columns the queries look rows up by.  Sorting inside files keeps Parquet
# row-group statistics narrow, so point lookups skip most row groups.
LOOKUP_COLUMN = {
    "users": "id",
    "posts": "author_id",
    "comments": "post_id",
    "likes": "user_id",
    "reposts": "user_id",
    "follows": "follower_id",
}

# Columns whose hash gives the bucket of a row.  Comments lie with their post, so a
# thread is in one bucket; an index says which post a comment is on.
BUCKET_KEY = {
    "users": "id",
    "posts": "id",
    "comments": "post_id",
    "likes": "message_id",
    "reposts": "message_id",
    "follows": "follower_id",
}
BUCKET = "bucket"
INDEX = "comment_index"
# A copy of the posts for requests that need the newest days alone.
MONTH = "month"
MONTHS = "posts_by_month"
LAYOUT = "layout"


def conform(frame: DataFrame, name: str) -> DataFrame:
    """Exactly the columns and types of table ``name``."""
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One table below ``path``; its schema is known, so no file is read for it."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
    return Tables(**{name: read_table(spark, name, path, fmt) for name in SCHEMAS})


def write_table(frame: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    """Write one table, sorted by its lookup column within its files."""
    conform(frame, name).sortWithinPartitions(LOOKUP_COLUMN[name]).write.mode(mode).parquet(f"{path}/{name}")


def write_tables(tables: Tables, path: str, mode: str = "errorifexists") -> None:
    for name, frame in tables.items():
        write_table(frame, name, path, mode)


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of an id."""
    return F.pmod(F.hash(key.cast("long")), F.lit(buckets))


def write_bucketed(
    frame: DataFrame, name: str, path: str, buckets: int, files: int = 1, dealt: bool = False
) -> None:
    """Write one table in folders by bucket, each of ``files`` files sorted by the lookup column.

    A large bucket comes in more files: no task takes more of one than the session's
    advisory partition size.  ``dealt``: a task of ``frame`` already has rows of few buckets,
    and is to write what it has.  With the comments goes their index, with the posts a copy
    by month.
    """

    def write(rows: DataFrame, key: str, order: str, to: str, dealt: bool = False) -> None:
        part = F.pmod(F.xxhash64("id"), F.lit(files))
        placed = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))
        if files > 1:
            placed = placed.repartition(F.col(BUCKET), part)
        elif not dealt:
            placed = placed.hint("rebalance", F.col(BUCKET))
        placed = placed.sortWithinPartitions(BUCKET, order)
        with shuffles_dropped(frame.sparkSession):
            placed.write.partitionBy(BUCKET).parquet(f"{path}/{to}", compression=CODEC)

    rows = conform(frame, name)
    write(rows, BUCKET_KEY[name], LOOKUP_COLUMN[name], name, dealt)
    if name == "comments":
        stored = frame.sparkSession.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
        write(stored.select("id", "post_id"), "id", "id", INDEX)
    if name == "posts":
        stored = frame.sparkSession.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
        write_parts(stored.withColumn(MONTH, month_of("created_at")), MONTH, "created_at", f"{path}/{MONTHS}")


def month_of(column: str) -> Column:
    """The first day of the month of a timestamp."""
    return F.trunc(column, "month")


def write_parts(rows: DataFrame, part: str, order: str, path: str, mode: str = "errorifexists") -> None:
    """Write rows in folders by the column ``part``, in order of the column ``order`` across files.

    A folder with very many rows is written by several tasks.  With the mode
    "overwrite" the folders that ``rows`` has are replaced, and no others.
    """
    dealt = rows.repartitionByRange(part, order).sortWithinPartitions(part, order)
    with shuffles_dropped(rows.sparkSession):
        writer = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(part)
        writer.parquet(path, compression=CODEC)


def write_layout(spark: SparkSession, path: str, buckets: int) -> None:
    """Note into how many buckets the tables below ``path`` are cut."""
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/{LAYOUT}")


def _read_parts(spark: SparkSession, path: str, fields: list[T.StructField], part: str, kind: T.DataType) -> DataFrame:
    return spark.read.schema(T.StructType([*fields, T.StructField(part, kind)])).parquet(path)


def _read_one(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    """What is stored of one table: itself by bucket, and its index or copy."""
    fields = SCHEMAS[name].fields
    found = {"table": _read_parts(spark, f"{path}/{name}", fields, BUCKET, T.IntegerType())}
    if name == "comments":
        named = [f for f in fields if f.name in ("id", "post_id")]
        found["index"] = _read_parts(spark, f"{path}/{INDEX}", named, BUCKET, T.IntegerType())
    if name == "posts":
        found["months"] = _read_parts(spark, f"{path}/{MONTHS}", fields, MONTH, T.DateType())
    return found


def read_bucketed(spark: SparkSession, path: str) -> Tables:
    """Tables written by ``write_bucketed``, which know their layout."""
    buckets = spark.read.schema("buckets int").parquet(f"{path}/{LAYOUT}").first()["buckets"]
    found = {name: _read_one(spark, path, name) for name in SCHEMAS}
    frames = {name: one["table"] for name, one in found.items()}
    layout = Layout(frames, found["comments"]["index"], buckets, found["posts"]["months"])
    return Tables(**{name: frame.drop(BUCKET) for name, frame in frames.items()}, layout=layout)


def with_stored(spark: SparkSession, tables: Tables, name: str, path: str) -> Tables:
    """``tables`` with one of them as it is now stored below ``path``, in as many buckets as the others."""
    one = _read_one(spark, path, name)
    frame = one.pop("table")
    layout = replace(tables.layout, frames={**tables.layout.frames, name: frame}, **one)
    return replace(tables, layout=layout, **{name: frame.drop(BUCKET)})
