"""Profile timelines, liked messages and plain association lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.engagement import MESSAGE_KEY, kind_of, viewer_id
from agora.operators.entries import all_entry_cards, entry_cards, labelled, own_entries, repost_entries
from agora.operators.joins import many_to_one
from agora.operators.messages import CARD
from agora.operators.pinning import in_order, pin
from agora.schema import COMMENT, COMMENT_REPOST, LIKE_TYPE, POST, REPOST_TYPE, Tables

TIMELINE = (*CARD, "post_type", "post_date", "reposted_by", "reposted_by_username")
LIKED = (*CARD, "like_id", "like_type", "liked_at", "reposted_by", "reposted_by_username")


def _timeline_entries(tables: Tables, kind: str, user: int | None) -> DataFrame:
    """Own messages of one kind and the reposts shown next to them."""
    messages = tables.posts if kind == POST else tables.comments
    reposts = tables.reposts
    if kind == COMMENT:
        reposts = reposts.filter(F.col("type") == COMMENT_REPOST)
    if user is not None:
        messages = messages.filter(F.col("author_id") == user)
        reposts = reposts.filter(F.col("user_id") == user)
    own = own_entries(messages, kind).withColumn("reposter_id", F.lit(None).cast("long"))
    return own.unionByName(repost_entries(reposts).withColumn("reposter_id", F.col("user_id")))


def _timeline(tables: Tables, kind: str, user: int, viewer: int | None) -> DataFrame:
    entries = pin(_timeline_entries(tables, kind, user).drop("user_id"))
    shown = entry_cards(tables, entries, viewer).select(*TIMELINE)
    return in_order(shown, entries.small, F.desc("post_date"), F.asc("post_type"), F.desc("id"))


def profile_posts(tables: Tables, user: int, viewer: int | None = None) -> DataFrame:
    """A user's posts and reposts of posts and comments, newest first."""
    return _timeline(tables, POST, user, viewer)


def profile_comments(tables: Tables, user: int, viewer: int | None = None) -> DataFrame:
    """A user's comments and replies and reposts of such, newest first."""
    return _timeline(tables, COMMENT, user, viewer)


def _timeline_all(tables: Tables, kind: str, viewer: int | None) -> DataFrame:
    entries = _timeline_entries(tables, kind, None)
    reposted = repost_entries(tables.reposts).select(*MESSAGE_KEY)
    shown = all_entry_cards(tables, entries, viewer, hot_from=reposted, whole=(kind,))
    return labelled(shown, F.lit(viewer_id(viewer))).select("user_id", *TIMELINE)


def profile_posts_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """``profile_posts`` of every user, seen by one viewer; not sorted."""
    return _timeline_all(tables, POST, viewer)


def profile_comments_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """``profile_comments`` of every user, seen by one viewer; not sorted."""
    return _timeline_all(tables, COMMENT, viewer)


def _like_entries(likes: DataFrame, reposts: DataFrame) -> DataFrame:
    """Likes, each with the liker as reposter if the liker also reposted it."""
    key = ["user_id", *MESSAGE_KEY]
    liked = likes.select(
        "user_id",
        kind_of().alias("kind"),
        F.col("message_id").alias("id"),
        F.col("id").alias("like_id"),
        F.col("type").alias("like_type"),
        F.col("created_at").alias("liked_at"),
    )
    also = repost_entries(reposts).select(*key, F.col("user_id").alias("reposter_id"))
    return liked.join(also, key, "left")


def liked_messages(tables: Tables, user: int, viewer: int | None = None) -> DataFrame:
    """The posts and comments a user likes, latest like first."""
    mine = F.col("user_id") == user
    entries = pin(_like_entries(tables.likes.filter(mine), tables.reposts.filter(mine)).drop("user_id"))
    return in_order(entry_cards(tables, entries, viewer).select(*LIKED), entries.small, F.desc("like_id"))


def liked_messages_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """``liked_messages`` of every user, seen by one viewer; not sorted."""
    entries = _like_entries(tables.likes, tables.reposts)
    liked = tables.likes.select(kind_of().alias("kind"), F.col("message_id").alias("id"))
    shown = all_entry_cards(tables, entries, viewer, hot_from=liked)
    return labelled(shown, F.lit(viewer_id(viewer))).select("user_id", *LIKED)


def _linked(tables: Tables, edges: DataFrame, tag: str, kind: str, user: int, when: str) -> DataFrame:
    """Messages a user has an edge to, newest edge first."""
    mine = edges.filter((F.col("type") == tag) & (F.col("user_id") == user)).select(
        F.col("message_id").alias("id"), F.col("created_at").alias(when)
    )
    keys = pin(mine)
    messages = tables.posts if kind == POST else tables.comments
    return in_order(messages.join(keys.hinted(), "id"), keys.small, F.desc(when), F.desc("id"))


def _linked_all(tables: Tables, edges: DataFrame, tag: str, kind: str, when: str) -> DataFrame:
    """Messages everybody has an edge to, keyed by ``user_id``; a hot message is split over tasks."""
    links = edges.filter(F.col("type") == tag).select("user_id", F.col("message_id").alias("id"), F.col("created_at").alias(when))
    messages = tables.posts if kind == POST else tables.comments
    return many_to_one(links, messages, ["id"], hot_from=links).select("user_id", *messages.columns, when)


def liked_posts_all(tables: Tables) -> DataFrame:
    """``liked_posts`` of every user; not sorted."""
    return _linked_all(tables, tables.likes, LIKE_TYPE[POST], POST, "liked_at")


def liked_comments_all(tables: Tables) -> DataFrame:
    """``liked_comments`` of every user; not sorted."""
    return _linked_all(tables, tables.likes, LIKE_TYPE[COMMENT], COMMENT, "liked_at")


def reposted_posts_all(tables: Tables) -> DataFrame:
    """``reposted_posts`` of every user; not sorted."""
    return _linked_all(tables, tables.reposts, REPOST_TYPE[POST], POST, "reposted_at")


def reposted_comments_all(tables: Tables) -> DataFrame:
    """``reposted_comments`` of every user; not sorted."""
    return _linked_all(tables, tables.reposts, REPOST_TYPE[COMMENT], COMMENT, "reposted_at")


def liked_posts(tables: Tables, user: int) -> DataFrame:
    return _linked(tables, tables.likes, LIKE_TYPE[POST], POST, user, "liked_at")


def liked_comments(tables: Tables, user: int) -> DataFrame:
    return _linked(tables, tables.likes, LIKE_TYPE[COMMENT], COMMENT, user, "liked_at")


def reposted_posts(tables: Tables, user: int) -> DataFrame:
    return _linked(tables, tables.reposts, REPOST_TYPE[POST], POST, user, "reposted_at")


def reposted_comments(tables: Tables, user: int) -> DataFrame:
    return _linked(tables, tables.reposts, REPOST_TYPE[COMMENT], COMMENT, user, "reposted_at")
