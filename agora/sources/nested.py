"""Writing nested records as JSON lines, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.operators.pinning import shuffles_dropped
from agora.sources.stored import BUCKET, bucket_of

# Times with microseconds; the default format would cut them to milliseconds.
_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_records(rows: DataFrame, key: str, path: str, buckets: int, dealt: bool = False) -> None:
    """One line per row, in folders by bucket of ``key``; fields that are null are written as null.

    Lines repeat field names and, in threads, texts, so files are compressed.  One cannot
    be split, so a large bucket is dealt over several.  ``dealt``: each task writes the rows
    it has, a file for each bucket, so that wide records are not moved for it.
    """
    keyed = rows.withColumn(BUCKET, bucket_of(rows[key], buckets))
    placed = (keyed if dealt else keyed.hint("rebalance", F.col(BUCKET))).sortWithinPartitions(BUCKET, key)
    with shuffles_dropped(rows.sparkSession):
        placed.write.options(**_FORMAT, ignoreNullFields="false", compression="gzip").partitionBy(BUCKET).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that ``write_records`` wrote; ``schema`` is theirs, and a line that does not fit it is an error."""
    stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(stored).options(**_FORMAT, mode="FAILFAST").json(path)
