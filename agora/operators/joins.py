"""Join shapes that hold when one key owns a large share of the rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators.pinning import BROADCAST_ROWS, Pinned, pin

# A key with more than this share of the rows is hot, so there are never more
# than 1/HOT_SHARE hot keys and their list can be broadcast; none is left out.
HOT_SHARE = 1e-5
# A key with fewer rows than this is never worth splitting.
HOT_ROWS = 100_000
# A frame derived from tables may be this many times their size and more is not
# broadcast on their account.
WIDENED = 7
# Parquet holds narrow rows in a fraction of what they take in a broadcast relation.
INFLATED = 7
# Keys are first counted by a hash into this many cells.
CELLS = 1 << 16

_UNITS = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}


def _broadcast_limit(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) * _UNITS.get(unit, 1)


def fits_broadcast(frame: DataFrame, times: int = 1) -> bool:
    """Whether ``times`` the optimizer's own size estimate lets it broadcast ``frame``."""
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) * times <= _broadcast_limit(frame.sparkSession)


def _hot_keys(facts: DataFrame, on: list[str], rows: int | None) -> tuple[DataFrame | None, int]:
    """``hot_keys``, or None if no cell has rows enough for one, and how many rows there are."""
    keyed = facts.select(*on).dropna().withColumn("__cell", F.pmod(F.xxhash64(*on), F.lit(CELLS)).cast("int"))
    cells = pin(keyed.groupBy("__cell").agg(F.count(F.lit(1)).alias("__rows"))).frame
    total, most = cells.agg(F.sum("__rows"), F.max("__rows")).first()
    least = max(HOT_ROWS if rows is None else rows, int((total or 0) * HOT_SHARE) + 1)
    if (most or 0) < least and (total or 0) >= HOT_ROWS:
        return None, total
    heavy = cells.filter(F.col("__rows") >= least).select("__cell")
    hot = (
        keyed.join(F.broadcast(heavy), "__cell", "left_semi")
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .filter(F.col("__rows") >= least)
        .select(*on, F.lit(True).alias("__hot"))
    )
    return hot, total or 0


def hot_keys(facts: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """All keys with at least ``rows`` rows and more than ``HOT_SHARE`` of all rows.

    A hot key lies in a cell with at least as many rows, so all rows are counted by cell,
    and by key only those of such cells: where no key is hot, no key is shuffled.
    """
    hot, _ = _hot_keys(facts, on, rows)
    return facts.select(*on, F.lit(True).alias("__hot")).limit(0) if hot is None else hot


def any_hot(facts: DataFrame, on: list[str], rows: int) -> bool:
    """Whether some key may have ``rows`` rows or more, null being a key; counted by cell."""
    cell = F.pmod(F.xxhash64(*on), F.lit(CELLS)).alias("__cell")
    most = facts.groupBy(cell).agg(F.count(F.lit(1)).alias("__rows")).agg(F.max("__rows")).first()[0]
    return (most or 0) >= rows


def many_to_one(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    hot_from: DataFrame | None = None,
    sized_by: DataFrame | None = None,
    few_from: DataFrame | None = None,
) -> DataFrame:
    """Join many fact rows to few ``dim`` rows per key, splitting hot keys.

    A ``dim`` within the session's broadcast limit needs no shuffle and so knows
    no skew.  Otherwise the rows of hot keys, and rows whose key is null, are
    spread over salts; ``dim`` rows are repeated only for the hot keys.

    ``hot_from``: a cheap frame to count the keys in, when ``facts`` is costly.
    ``sized_by``: stored tables with a row for each row of ``dim``, when ``dim`` is
    itself a join, whose size the optimizer can only overestimate.
    ``few_from``: a cheap frame with the keys of ``facts``, when they may name few of many
    ``dim`` rows; if they do, those rows alone are moved.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"many_to_one joins are inner or left, not {how}")
    if fits_broadcast(dim, INFLATED):
        return facts.join(dim, on, how)
    if sized_by is not None and fits_broadcast(sized_by, WIDENED):
        return facts.join(F.broadcast(dim), on, how)
    if few_from is not None:
        named = pin(few_from.select(*on).dropna().distinct().limit(BROADCAST_ROWS + 1))
        if named.small:
            found = pin(dim.join(named.hinted(), on, "left_semi"))
            if found.small:
                return facts.join(found.hinted(), on, how)
            dim = found.frame
    return _salted(facts, dim, on, how, hot_from)


def _salted(facts: DataFrame, dim: DataFrame, on: list[str], how: str, hot_from: DataFrame | None) -> DataFrame:
    """``many_to_one`` without a broadcast of ``dim``.

    Without hot keys an inner join of many rows takes no salt, so that a side that already lies by its
    key is not shuffled again.
    """
    hot, _ = _hot_keys(facts if hot_from is None else hot_from, on, None)
    if hot is None and how == "inner":
        return facts.join(dim.hint("merge"), on)
    salts = max(8, min(512, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))

    any_null = F.lit(False)
    for key in on:
        any_null = any_null | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    if hot is None:
        nulls_spread = facts.withColumn("__salt", F.when(any_null, spread).otherwise(F.lit(0)))
        return nulls_spread.join(dim.withColumn("__salt", F.lit(0)).hint("merge"), [*on, "__salt"], how).drop("__salt")
    hot = F.broadcast(hot)
    salted_facts = (
        facts.join(hot, on, "left")
        .withColumn("__salt", F.when(F.col("__hot") | any_null, spread).otherwise(F.lit(0)))
        .drop("__hot")
    )
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_dim = (
        dim.join(hot, on, "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot"), every_salt).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    # Without hot keys the adaptive planner would go by the files behind ``dim`` again.
    return salted_facts.join(salted_dim.hint("merge"), [*on, "__salt"], how).drop("__salt")


def keep_found(facts: DataFrame, keys: Pinned, on: list[str], hot_from: DataFrame | None = None) -> DataFrame:
    """Fact rows whose key is among the computed, distinct ``keys``."""
    if keys.small:
        return facts.join(keys.hinted(*on), on, "left_semi")
    # Too many for a broadcast, however small their files.
    return _salted(facts, keys.frame.select(*on), on, "inner", hot_from)


def drop_found(facts: DataFrame, keys: Pinned, on: list[str], hot_from: DataFrame | None = None) -> DataFrame:
    """Fact rows whose key is not among the computed, distinct ``keys``."""
    if keys.small:
        return facts.join(keys.hinted(*on), on, "left_anti")
    marked = keys.frame.select(*on, F.lit(True).alias("__found"))
    found = _salted(facts, marked, on, "left", hot_from)
    return found.filter(F.col("__found").isNull()).drop("__found")
