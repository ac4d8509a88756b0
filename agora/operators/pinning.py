"""Computing a frame once, and knowing how many rows it has."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from agora.session import shared_dir

# A frame of keys and short texts (a text has at most 200 characters) is only
# ever broadcast behind a check that it has no more rows than this.
BROADCAST_ROWS = 100_000
# How files are packed that this package writes and reads again.
CODEC = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The tables each application has written and not deleted yet.
_written: dict[str, list[str]] = defaultdict(list)


@dataclass(frozen=True)
class Pinned:
    """A frame already computed into the shared folder, with its exact row count."""

    frame: DataFrame
    rows: int

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS

    def hinted(self, *columns: str) -> DataFrame:
        """The frame, to be broadcast when its counted size allows, and only then.

        The optimizer would go by the size of its files, which hold narrow rows in a
        fraction of what they take in memory.
        """
        frame = self.frame.select(*columns) if columns else self.frame
        return F.broadcast(frame) if self.small else frame.hint("merge")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes whose shuffle files go when each ends, not when the driver next collects garbage.

    Only for writes: what they read is planned anew for them and never run again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def pin(frame: DataFrame, codec: str = CODEC) -> Pinned:
    """Compute ``frame`` once, as a Parquet table in the shared folder.

    The rows are counted while they are written, so this is one job.  Losing an
    executor later costs nothing, since the rows are read back from the folder,
    and the optimizer plans on with the table's true size instead of an estimate
    that grows with every join behind it.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/agora-pinned-{uuid.uuid4().hex}"
    seen = Observation()
    _written[spark.sparkContext.applicationId].append(path)
    with shuffles_dropped(spark):
        frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path, compression=codec)
    return Pinned(spark.read.schema(frame.schema).parquet(path), int(seen.get["rows"]))


def forget(spark: SparkSession, after: int = 0) -> None:
    """Delete the tables this application has pinned, but the first ``after`` of them.

    Only frames whose results are no longer needed may depend on them.
    """
    paths = _written[spark.sparkContext.applicationId]
    for path in paths[after:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del paths[after:]


@contextmanager
def request(spark: SparkSession) -> Iterator[None]:
    """A request whose intermediates go when it ends; write its result inside."""
    before = len(_written[spark.sparkContext.applicationId])
    try:
        yield
    finally:
        forget(spark, before)


def distilled(spark: SparkSession, make: Callable[[], DataFrame]) -> Pinned:
    """``make()`` pinned, and what was pinned on the way to it deleted.

    A long chain of joins made in such steps never holds the shuffles of more than one.
    """
    paths = _written[spark.sparkContext.applicationId]
    before = len(paths)
    last = pin(make())
    path = paths.pop()
    forget(spark, before)
    paths.append(path)
    return last


def few_or_all(rows: DataFrame) -> tuple[DataFrame, Pinned | None]:
    """``rows`` computed and counted if they are few, else untouched.

    One pass over the source keeps at most ``BROADCAST_ROWS`` + 1 rows.  If that
    was all of them, everything after can work on the kept rows, which are few
    enough to broadcast.  If not, the kept rows are left aside and the caller
    works on ``rows`` itself, all of them.
    """
    kept = pin(rows.limit(BROADCAST_ROWS + 1))
    return (kept.frame, kept) if kept.small else (rows, None)


def in_order(rows: DataFrame, few: bool, *keys: Column) -> DataFrame:
    """``rows`` sorted; a few are shuffled into one task instead of sampled for ranges."""
    return rows.repartition(1).sortWithinPartitions(*keys) if few else rows.orderBy(*keys)
