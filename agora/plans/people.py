"""User statistics and follow lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.engagement import viewer_id
from agora.operators.follows import follow_marks
from agora.operators.joins import many_to_one
from agora.operators.pinning import Pinned, in_order, pin
from agora.schema import Tables

STATS = ("post_count", "following_count", "follower_count")
LISTED = ("id", "username", "display_name", "followed_at", "following_current_user", "current_user_following")


def by_username(tables: Tables, username: str) -> DataFrame:
    """The user with this name, in whatever case."""
    return tables.users.filter(F.lower("username") == F.lower(F.lit(username)))


def _tallies(tables: Tables, only: Pinned | None = None) -> DataFrame:
    """(id, three counts) per user, from one aggregation over posts and follows."""

    def narrow(rows: DataFrame, key: str, counter: str) -> DataFrame:
        return rows.select(F.col(key).alias("id"), *[F.lit(1 if c == counter else 0).alias(c) for c in STATS])

    stacked = (
        narrow(tables.posts, "author_id", "post_count")
        .unionByName(narrow(tables.follows, "follower_id", "following_count"))
        .unionByName(narrow(tables.follows, "followee_id", "follower_count"))
    )
    if only is not None and only.small:
        stacked = stacked.join(only.hinted("id"), "id", "left_semi")
    return stacked.groupBy("id").agg(*[F.sum(c).alias(c) for c in STATS])


def user_counts(tables: Tables) -> DataFrame:
    """Posts, followed users and followers of every user."""
    return tables.users.select("id").join(_tallies(tables), "id", "left").fillna(0, list(STATS))


def _stats(tables: Tables, users: DataFrame, tallies: DataFrame, viewer: int | None) -> DataFrame:
    people = users.select("id", "username", "display_name", "email", "created_at")
    counted = people.join(tallies, "id", "left").fillna(0, list(STATS))
    return follow_marks(tables, counted, viewer_id(viewer)).drop("following_current_user")


def user_stats(tables: Tables, username: str, viewer: int | None = None) -> DataFrame:
    user = pin(by_username(tables, username))
    return _stats(tables, user.frame, _tallies(tables, user), viewer)


def user_stats_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    return _stats(tables, tables.users, _tallies(tables), viewer)


def _follow_list(tables: Tables, username: str, viewer: int | None, mine: str, other: str) -> DataFrame:
    user = pin(by_username(tables, username).select(F.col("id").alias(mine)))
    edges = pin(
        tables.follows.join(user.hinted(), mine).select(F.col(other).alias("id"), F.col("created_at").alias("followed_at"))
    )
    people = tables.users.select("id", "username", "display_name").join(edges.hinted(), "id")
    marked = follow_marks(tables, people, viewer_id(viewer))
    return in_order(marked.select(*LISTED), edges.small, F.desc("followed_at"), F.desc("id"))


def followed_users(tables: Tables, username: str, viewer: int | None = None) -> DataFrame:
    """Whom a user follows, the latest follow first."""
    return _follow_list(tables, username, viewer, "follower_id", "followee_id")


def followers(tables: Tables, username: str, viewer: int | None = None) -> DataFrame:
    """Who follows a user, the latest follow first."""
    return _follow_list(tables, username, viewer, "followee_id", "follower_id")


def _follow_list_all(tables: Tables, viewer: int | None, mine: str, other: str) -> DataFrame:
    edges = tables.follows.select(
        F.col(mine).alias("user_id"), F.col(other).alias("id"), F.col("created_at").alias("followed_at")
    )
    people = follow_marks(tables, tables.users.select("id", "username", "display_name"), viewer_id(viewer))
    return many_to_one(edges, people, ["id"], sized_by=tables.users).select("user_id", *LISTED)


def followed_users_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """``followed_users`` of every user, keyed by ``user_id``; not sorted."""
    return _follow_list_all(tables, viewer, "follower_id", "followee_id")


def followers_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """``followers`` of every user, keyed by ``user_id``; not sorted."""
    return _follow_list_all(tables, viewer, "followee_id", "follower_id")
