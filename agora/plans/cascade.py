"""Deleting messages and users with everything that hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.engagement import MESSAGE_KEY, kind_of
from agora.operators.joins import drop_found, keep_found, many_to_one
from agora.operators.pinning import Pinned, pin
from agora.schema import COMMENT, POST, Tables

# Why a deletion is refused.
OTHERS = {POST: "Cannot delete other's posts.", COMMENT: "Cannot delete other's comments."}
NOT_FOUND = {POST: "Unable to find Post at given ID: ", COMMENT: "Unable to find Comment at given ID: "}


def delete_requests(tables: Tables, kind: str, requests: DataFrame) -> DataFrame:
    """Judge (actor_id, id) requests: ``reason`` is null where the actor wrote the message."""
    table = tables.posts if kind == POST else tables.comments
    authors = table.select("id", "author_id")
    judged = many_to_one(requests.select("actor_id", "id"), authors, ["id"], "left")
    missing = F.concat(F.lit(NOT_FOUND[kind]), F.col("id").cast("string"))
    reason = F.when(F.col("author_id").isNull(), missing).when(
        F.col("author_id") != F.col("actor_id"), F.lit(OTHERS[kind])
    )
    return judged.select("actor_id", "id", reason.alias("reason"))


def _below(comments: DataFrame, roots: Pinned) -> DataFrame:
    """(id) of ``roots`` and all comments below them, at any depth.

    Replies are on the post of their parent, so only threads with a root in
    them are looked at.  Each comment there points to an ancestor and knows
    whether a root lies on the way; a round lets every comment jump to where its
    ancestor points.  A thread of depth d takes log2(d) rounds, whatever its
    shape, and each round is kept in the shared folder.
    """
    narrow = comments.select("id", "post_id", "parent_id")
    threads = pin(keep_found(narrow, roots, ["id"]).select("post_id").distinct())
    marked = roots.frame.select("id", F.lit(True).alias("hit"))
    nodes = keep_found(narrow, threads, ["post_id"]).join(marked, "id", "left").select(
        "id", F.col("parent_id").alias("above"), F.coalesce("hit", F.lit(False)).alias("hit")
    )
    is_open = ~F.col("hit") & F.col("above").isNotNull()
    state = pin(nodes).frame
    before = None
    while True:
        open_nodes = pin(state.filter(is_open))
        if open_nodes.rows == 0:
            return state.filter("hit").select("id")
        # The open comment nearest to its top settles in every round.
        if open_nodes.rows == before:
            raise ValueError("comments form a cycle through parent_id")
        before = open_nodes.rows
        targets = state.select(
            F.col("id").alias("above"), F.col("above").alias("next_above"), F.col("hit").alias("hit_above")
        )
        jumped = many_to_one(open_nodes.frame.select("id", "above"), targets, ["above"], "left").select(
            "id", F.col("next_above").alias("above"), F.coalesce("hit_above", F.lit(False)).alias("hit")
        )
        state = pin(state.filter(~is_open).unionByName(jumped)).frame


def cascade_delete(
    tables: Tables,
    posts: DataFrame | None = None,
    comments: DataFrame | None = None,
    users: DataFrame | None = None,
) -> Tables:
    """The tables without the given posts, comments and users (frames of ``id``).

    A post takes its comments with it, a comment the replies below it, a message
    its likes and reposts, a user all they wrote, both directions of their
    follows, and their likes and reposts.
    """
    def ids(frame: DataFrame | None) -> Pinned:
        empty = tables.users.select("id").limit(0)
        return pin((empty if frame is None else frame.select("id")).distinct())

    gone_users, asked_posts, asked_comments = ids(users), ids(posts), ids(comments)
    by_gone = [Pinned(gone_users.frame.withColumnRenamed("id", "author_id"), gone_users.rows), ["author_id"]]

    gone_posts = asked_posts
    if gone_users.rows:
        theirs = keep_found(tables.posts, *by_gone).select("id")
        gone_posts = pin(asked_posts.frame.unionByName(theirs).distinct())

    on_posts = Pinned(gone_posts.frame.withColumnRenamed("id", "post_id"), gone_posts.rows)
    under_posts = keep_found(tables.comments, on_posts, ["post_id"]).select("id")
    roots = asked_comments.frame
    if gone_users.rows:
        roots = roots.unionByName(keep_found(tables.comments, *by_gone).select("id")).distinct()
    roots = pin(roots)
    below = _below(tables.comments, roots) if roots.rows else roots.frame
    gone_comments = pin(below.unionByName(under_posts).distinct())

    gone_messages = pin(
        gone_posts.frame.select(F.lit(POST).alias("kind"), "id").unionByName(
            gone_comments.frame.select(F.lit(COMMENT).alias("kind"), "id")
        )
    )

    def edges(frame: DataFrame) -> DataFrame:
        columns = frame.columns
        keyed = frame.withColumnsRenamed({"id": "edge_id", "message_id": "id"}).withColumn("kind", kind_of())
        left = drop_found(keyed, gone_messages, MESSAGE_KEY).withColumnsRenamed({"id": "message_id", "edge_id": "id"})
        return without_users(left, "user_id").select(*columns)

    def without_users(frame: DataFrame, key: str) -> DataFrame:
        if not gone_users.rows:
            return frame
        return drop_found(frame, Pinned(gone_users.frame.withColumnRenamed("id", key), gone_users.rows), [key])

    follows = without_users(without_users(tables.follows, "follower_id"), "followee_id")
    return Tables(
        users=without_users(tables.users, "id"),
        posts=drop_found(tables.posts, gone_posts, ["id"]),
        comments=drop_found(tables.comments, gone_comments, ["id"]),
        likes=edges(tables.likes),
        reposts=edges(tables.reposts),
        follows=follows,
    )


def remaining_ids(tables: Tables) -> DataFrame:
    """(table, id) of every row of the six tables."""
    frames = [frame.select(F.lit(name).alias("table"), "id") for name, frame in tables.items()]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    return every
