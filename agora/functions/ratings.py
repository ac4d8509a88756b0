"""Ratings and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of a message rating.
REPOST_WEIGHT = 3
LIKE_WEIGHT = 2
COMMENT_WEIGHT = 1
# Weights of a user rating.
SELF_BONUS = 1000
FOLLOWED_BONUS = 15
FOLLOWER_WEIGHT = 3
FOLLOWED_WEIGHT = 1
# Fixed value: a comment enters the popular feed with more reposts than this.
POPULAR_COMMENT_REPOSTS = 4
# Fixed value: how a viewer's own repost is labelled.
OWN_REPOST = "You"


def message_rating() -> Column:
    return (
        F.col("repost_count") * REPOST_WEIGHT
        + F.col("like_count") * LIKE_WEIGHT
        + F.col("comment_count") * COMMENT_WEIGHT
    )


def user_rating(viewer: int) -> Column:
    return (
        F.when(F.col("id") == viewer, SELF_BONUS).otherwise(0)
        + F.when(F.col("current_user_following"), FOLLOWED_BONUS).otherwise(0)
        + F.col("follower_count") * FOLLOWER_WEIGHT
        + F.col("followed_user_count") * FOLLOWED_WEIGHT
    )


def reposter_label(reposter: Column, viewer: Column, display_name: Column) -> Column:
    """'You' for the viewer's own repost, the reposter's name otherwise, null without a repost."""
    return F.when(reposter.isNotNull() & (reposter == viewer), F.lit(OWN_REPOST)).when(
        reposter.isNotNull(), display_name
    )
