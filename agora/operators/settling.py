"""Settling requests that depend on each other, in logarithmically many rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.joins import keep_found, many_to_one
from agora.operators.pinning import pin


def follow(links: DataFrame) -> tuple[DataFrame, int]:
    """(seq, value) of every request, and the number of rounds it took.

    ``links``: seq, up, yes, no, value.  A row with ``value`` is known.  A row with ``up``
    has the value ``yes`` if the row it points to turns out true, else ``no``.  A row with
    neither stays open, and with it all that points there.  The pointers form no cycle.

    Rows jump over the row they point to and compose what hangs on it, so a chain of n
    rows takes log2(n) rounds.
    """
    state, rounds = pin(links.select("seq", "up", "yes", "no", "value")), 0
    waits = F.col("up").isNotNull()
    open_ = state.frame.filter(waits)
    settled = [state.frame.filter(~waits)]
    # Rows to point to: of those settled before the first round only the ends of chains.
    ends = settled[0]
    if not state.small:
        asked = pin(open_.select(F.col("up").alias("seq")).distinct())
        ends = pin(keep_found(ends, asked, ["seq"])).frame
    below = [ends]
    while open_.limit(1).count():
        rounds += 1
        above = reduce(DataFrame.unionByName, [*below, open_]).select(
            F.col("seq").alias("up"), F.col("up").alias("up_2"), F.col("yes").alias("yes_2"), F.col("no").alias("no_2"),
            F.col("value").alias("value_2"),
        )
        met = many_to_one(open_, above, ["up"], "left", few_from=open_)

        def through(value: str):
            return F.when(F.col(value), F.col("yes")).when(~F.col(value), F.col("no"))

        jumped = met.select(
            "seq",
            F.col("up_2").alias("up"),
            through("yes_2").alias("yes"),
            through("no_2").alias("no"),
            through("value_2").alias("value"),
        )
        same = F.col("up").isNotNull() & (F.col("yes") == F.col("no"))
        moved = jumped.select(
            "seq", F.when(~same, F.col("up")).alias("up"), "yes", "no", F.when(same, F.col("yes")).otherwise(F.col("value")).alias("value")
        )
        if state.small:
            # One small file is read faster than one a round.
            moved, settled, below = settled[0].unionByName(moved), [], []
        # Of many rows only those that were open are written again.
        moved = pin(moved).frame
        settled.append(moved.filter(~waits))
        below.append(settled[-1])
        open_ = moved.filter(waits)
    return reduce(DataFrame.unionByName, settled).select("seq", "value"), rounds
