"""Nested lists that stay bounded however long the list is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.operators.joins import drop_found, keep_found
from agora.operators.pinning import pin

PART_ROWS = 1000


def ranked_in_ranges(rows: DataFrame, owner: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (``name``, from 1) in the order of their owner, computed and written.

    Rows are range-partitioned by owner and order and ranked within a range, and the
    counts of the ranges before are added, so an owner of any share of the rows is
    ranked by many tasks.  ``order`` should leave no two rows of an owner equal.
    """
    owned = rows.filter(F.col(owner).isNotNull())
    ranges = pin(owned.repartitionByRange(owner, *order).withColumn("__range", F.spark_partition_id())).frame
    # Only the last owner of a range can go on in the next, so few have ranges to count.
    last = ranges.groupBy("__range").agg(F.max(owner).alias(owner)).select(owner).distinct()
    counts = ranges.join(F.broadcast(last), owner, "left_semi").groupBy(owner, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(owner).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(owner, "__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(owner, "__range").orderBy(*order)
    placed = ranges.withColumn("__place", F.row_number().over(within)).join(F.broadcast(before), [owner, "__range"], "left")
    place = (F.col("__place") + F.coalesce("__before", F.lit(0))).cast("int")
    return placed.withColumn(name, place).drop("__place", "__before", "__range")


def nest(
    rows: DataFrame, owner: str, fields: list[str], name: str, newest: str = "created_at", part_rows: int = PART_ROWS
) -> DataFrame:
    """One row (owner, part, parts, ``name``) per owner and part of its list.

    Part 0 holds the newest ``part_rows`` rows, newest first, part 1 the next, and
    so on; every list has this shape.  Rows are computed once, and lists of one part are
    gathered in one shuffle.  A longer list is ranked in ranges, see
    ``ranked_in_ranges``, so no task ever holds an unbounded list.
    """
    spread = rows.select(F.col(owner), F.col(newest).alias("__newest"), F.col("id").alias("__id"), F.struct(*fields).alias("__record"))
    owned = pin(spread.filter(F.col(owner).isNotNull())).frame
    long = pin(owned.groupBy(owner).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > part_rows).select(owner))
    short = drop_found(owned, long, [owner]) if long.rows else owned
    gathered = short.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("__newest", "__id", "__record")), asc=False).alias("__list"))
    records = F.transform("__list", lambda r: r["__record"]).alias(name)
    whole = gathered.select(owner, F.lit(0).alias("part"), F.lit(1).alias("parts"), records)
    if not long.rows:
        return whole
    order = [F.col("__newest").desc(), F.col("__id").desc()]
    ranked = ranked_in_ranges(keep_found(owned, long, [owner]), owner, order, "__rank").withColumn(
        "part", F.floor((F.col("__rank") - 1) / part_rows).cast("int")
    )
    listed = ranked.groupBy(owner, "part").agg(
        F.sort_array(F.collect_list(F.struct("__rank", "__record"))).alias("__list")
    )
    # The last part knows how many there are; there is one row per part here.
    listed = listed.withColumn("parts", F.max(F.col("part") + 1).over(Window.partitionBy(owner)))
    return whole.unionByName(listed.select(owner, "part", "parts", records))
