"""The previous action on the same key, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sequence numbers per block; a key's rows of one block meet in one task.
BLOCK = 1_000_000


def with_previous(
    rows: DataFrame, key: list[str], order: str, value: str, name: str, block: int = BLOCK, few: bool = False
) -> DataFrame:
    """Add ``name``: the ``value`` of the row before in ``order`` with the same key.

    A key may own any share of the rows.  They are cut into blocks of sequence
    numbers: inside a block a window finds the row before, and the first row of
    a block takes the last value of the key's block before, which a small
    aggregate of one row per key and block provides.  ``few`` says that no key has more
    rows than a block, so that one window will do.
    """
    if few:
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*key).orderBy(order)))
    cut = rows.withColumn("__block", F.floor(F.col(order) / block))
    in_block = Window.partitionBy(*key, "__block").orderBy(order)
    by_block = Window.partitionBy(*key).orderBy("__block")
    ends = (
        cut.groupBy(*key, "__block")
        .agg(F.max_by(value, order).alias("__last"))
        .withColumn("__before", F.lag("__last").over(by_block))
        .select(*key, "__block", "__before")
    )
    return (
        cut.withColumn("__lag", F.lag(value).over(in_block))
        .join(ends, [*key, "__block"], "left")
        .withColumn(name, F.coalesce("__lag", "__before"))
        .drop("__lag", "__before", "__block")
    )


def with_last(
    rows: DataFrame, key: list[str], order: str, value: str, name: str, few: bool = False, block: int = BLOCK
) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null in the rows before with the same key.

    As ``with_previous``, but rows without a value are looked past.  ``few`` says that
    no key has more rows than a block, so that one window will do.
    """
    if few:
        before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))
    cut = rows.withColumn("__block", F.floor(F.col(order) / block))
    in_block = Window.partitionBy(*key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    by_block = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    valued = F.when(F.col(value).isNotNull(), F.col(order))
    ends = (
        cut.groupBy(*key, "__block")
        .agg(F.max_by(value, valued).alias("__end"))
        .withColumn("__before", F.last("__end", ignorenulls=True).over(by_block))
        .select(*key, "__block", "__before")
    )
    return (
        cut.withColumn("__last", F.last(value, ignorenulls=True).over(in_block))
        .join(ends, [*key, "__block"], "left")
        .withColumn(name, F.coalesce("__last", "__before"))
        .drop("__last", "__before", "__block")
    )
