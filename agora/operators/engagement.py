"""Likes, reposts and comments counted per message, in one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions.ratings import message_rating
from agora.operators.pinning import Pinned
from agora.schema import COMMENT, LIKE_TYPE, POST, REPOST_TYPE, Tables

COUNTS = ("like_count", "repost_count", "comment_count")
FLAGS = ("user_liked", "user_reposted")
MESSAGE_KEY = ["kind", "id"]


def viewer_id(viewer: int | None) -> int:
    """Nobody signed in is viewer 0, who owns no edges."""
    return 0 if viewer is None else viewer


def kind_of(tag: str = "type") -> Column:
    """'Post' or 'Comment' from a like or repost type."""
    return F.when(F.col(tag).startswith(POST), F.lit(POST)).otherwise(F.lit(COMMENT))


def _marks(tables: Tables, kinds: tuple[str, ...], viewer: int) -> list[DataFrame]:
    """Narrow rows (kind, id, one counter set, whose mark) of the three sources."""

    def edges(frame: DataFrame, tags: dict[str, str], *columns: str) -> DataFrame:
        wanted = [tags[kind] for kind in kinds]
        kind = f"'{kinds[0]}'" if len(kinds) == 1 else f"CASE WHEN type = '{tags[POST]}' THEN '{POST}' ELSE '{COMMENT}' END"
        return frame.filter(F.col("type").isin(wanted)).selectExpr(f"{kind} AS kind", "message_id AS id", *columns)

    mine = f"user_id = {viewer}"
    likes = ("1 AS like_count", "0 AS repost_count", "0 AS comment_count", f"{mine} AS user_liked", "false AS user_reposted")
    reposts = ("0 AS like_count", "1 AS repost_count", "0 AS comment_count", "false AS user_liked", f"{mine} AS user_reposted")
    comments = ("0 AS like_count", "0 AS repost_count", "1 AS comment_count", "false AS user_liked", "false AS user_reposted")
    return [
        edges(tables.likes, LIKE_TYPE, *likes),
        edges(tables.reposts, REPOST_TYPE, *reposts),
        counted_for(tables, *kinds).selectExpr("kind", "id", *comments),
    ]


def counted_for(tables: Tables, *kinds: str) -> DataFrame:
    """(kind, id) of the message each comment counts for.

    A post counts its top-level comments, a comment its direct replies.
    """
    if len(kinds) > 1:
        return tables.comments.selectExpr(
            f"CASE WHEN parent_id IS NULL THEN '{POST}' ELSE '{COMMENT}' END AS kind",
            "coalesce(parent_id, post_id) AS id",
        )
    if kinds[0] == POST:
        return tables.comments.filter("parent_id IS NULL").selectExpr(f"'{POST}' AS kind", "post_id AS id")
    return tables.comments.filter("parent_id IS NOT NULL").selectExpr(f"'{COMMENT}' AS kind", "parent_id AS id")


def engagement(tables: Tables, *kinds: str, viewer: int | None = None, only: Pinned | None = None) -> DataFrame:
    """One row (kind, id) per message that has a like, a repost or a comment.

    The three sources are stacked as narrow rows and aggregated together: one
    map-side pre-aggregation and one shuffle by message, however many edges a
    message has.  The viewer's own marks fall out of the same aggregation.
    With ``only``, computed (kind, id) keys, all else is filtered out first.
    """
    stacked = reduce(DataFrame.union, _marks(tables, kinds, viewer_id(viewer)))
    few = only is not None and only.small
    if few:
        stacked = stacked.join(only.hinted(*MESSAGE_KEY), MESSAGE_KEY, "left_semi")
    # One kind needs no key of its own, and lies by id for the joins to come.
    key = ["id"] if len(kinds) == 1 else MESSAGE_KEY
    counts = stacked.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in COUNTS], *[F.bool_or(c).alias(c) for c in FLAGS]
    )
    if len(kinds) == 1:
        counts = counts.select(F.lit(kinds[0]).alias("kind"), "*")
    # At most one row per key of ``only``, whose number is known.
    return F.broadcast(counts) if few else counts


def with_engagement(rows: DataFrame, counts: DataFrame, one_kind: bool = False) -> DataFrame:
    """Message rows with counts, marks and rating; nothing found counts as 0.

    ``one_kind``: all rows and counts are of the same kind, so ids will do.
    """
    found = rows.join(counts.drop("kind"), "id", "left") if one_kind else rows.join(counts, MESSAGE_KEY, "left")
    filled = found.selectExpr(
        *rows.columns,
        *[f"coalesce({c}, 0) AS {c}" for c in COUNTS],
        *[f"coalesce({c}, false) AS {c}" for c in FLAGS],
    )
    return filled.select("*", message_rating().alias("rating"))
