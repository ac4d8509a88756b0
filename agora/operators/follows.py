"""Follower counts and follow marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.pinning import Pinned
from agora.schema import Tables


def follow_counts(tables: Tables, users: DataFrame, only: Pinned | None = None) -> DataFrame:
    """User rows with follower_count and followed_user_count.

    Each follow edge is counted once for either end in one aggregation by user.
    """
    ends = tables.follows.select(
        F.explode(
            F.array(
                F.struct(F.col("followee_id").alias("id"), F.lit(1).alias("follower"), F.lit(0).alias("followed")),
                F.struct(F.col("follower_id").alias("id"), F.lit(0).alias("follower"), F.lit(1).alias("followed")),
            )
        ).alias("end")
    ).select("end.*")
    if only is not None and only.small:
        ends = ends.join(only.hinted("id"), "id", "left_semi")
    counts = ends.groupBy("id").agg(
        F.sum("follower").alias("follower_count"), F.sum("followed").alias("followed_user_count")
    )
    return users.join(counts, "id", "left").fillna(0, ["follower_count", "followed_user_count"])


def follow_marks(tables: Tables, users: DataFrame, viewer: int, key: str = "id") -> DataFrame:
    """User rows with whether the viewer follows them and they the viewer.

    Both directions come from one scan of the viewer's edges.
    """
    touching = tables.follows.filter((F.col("follower_id") == viewer) | (F.col("followee_id") == viewer))
    outgoing = F.col("follower_id") == viewer
    marks = (
        touching.select(
            F.when(outgoing, F.col("followee_id")).otherwise(F.col("follower_id")).alias(key),
            outgoing.alias("current_user_following"),
            (~outgoing).alias("following_current_user"),
        )
        .groupBy(key)
        .agg(
            F.bool_or("current_user_following").alias("current_user_following"),
            F.bool_or("following_current_user").alias("following_current_user"),
        )
    )
    return users.join(marks, key, "left").fillna(False, ["current_user_following", "following_current_user"])
