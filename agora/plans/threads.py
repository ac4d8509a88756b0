"""Threads and message details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.entries import entry_cards
from agora.operators.joins import many_to_one
from agora.operators.messages import CARD, author_record, cards, comments_as_messages, posts_as_messages, steps
from agora.operators.nesting import nest
from agora.operators.pinning import in_order, pin
from agora.operators.plain import PLAIN, plain_entries, plain_messages, with_parents
from agora.operators.pruning import rows_at, thread_around
from agora.schema import COMMENT, POST, Tables

# Which part of a thread a row is.
OWN_COMMENT = "OriginalComment"
OWN_COMMENT_POST = "OriginalCommentPost"
OWN_COMMENT_REPLY = "OriginalCommentReply"
PARENT_COMMENT = "ParentComment"


def _tagged(rows: DataFrame, kind: str, show_type: str, key: str = "id") -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(show_type).alias("show_type"))


def _part(kind: str, key: str, show_type: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(show_type).alias("show_type"))


def _around(comments: DataFrame, *kept: str) -> DataFrame:
    """A comment, its post and its parent as three (kind, id, show_type) rows."""
    parts = F.array(
        _part(COMMENT, "id", OWN_COMMENT),
        _part(POST, "post_id", OWN_COMMENT_POST),
        _part(COMMENT, "parent_id", PARENT_COMMENT),
    )
    exploded = comments.select(*[F.col("id").alias(k) for k in kept], F.explode(parts).alias("part"))
    return exploded.select(*kept, "part.*").filter(F.col("id").isNotNull())


def _newest_first() -> list[Column]:
    return [F.desc("created_at"), F.asc("show_type"), F.desc("id")]


def post_thread(tables: Tables, post: int, viewer: int | None = None) -> DataFrame:
    """A post and its top-level comments as cards, newest first."""
    own = rows_at(tables, "posts", "id", post)
    top_level = rows_at(tables, "comments", "post_id", post).filter(F.col("parent_id").isNull())
    entries = pin(_tagged(own, POST, POST).unionByName(_tagged(top_level, COMMENT, COMMENT)))
    shown = entry_cards(tables, entries, viewer).select("show_type", *CARD)
    return in_order(shown, entries.small, *_newest_first())


def comment_thread(tables: Tables, comment: int, viewer: int | None = None) -> DataFrame:
    """A comment, its post, its parent if any, and its direct replies."""
    thread = thread_around(tables, comment)
    own = _around(thread.filter(F.col("id") == comment))
    replies = thread.filter(F.col("parent_id") == comment)
    entries = pin(own.unionByName(_tagged(replies, COMMENT, OWN_COMMENT_REPLY)))
    shown = entry_cards(tables, entries, viewer).select("show_type", *CARD)
    return in_order(shown, entries.small, *_newest_first())


def post_threads_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """Every post's thread, keyed by ``thread_id``; not sorted.

    A top-level comment already knows its post, so no join is needed at all.
    """
    posts = cards(tables, POST, viewer).select(
        F.col("id").alias("thread_id"), F.lit(POST).alias("show_type"), *CARD
    )
    top_level = comments_as_messages(tables.comments).filter(F.col("parent_id").isNull())
    comments = cards(tables, COMMENT, viewer, top_level).select(
        F.col("post_id").alias("thread_id"), F.lit(COMMENT).alias("show_type"), *CARD
    )
    return posts.unionByName(comments)


def comment_threads_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """Every comment's thread, keyed by ``thread_id``; not sorted."""
    comments = steps(tables)(lambda: cards(tables, COMMENT, viewer))
    shown_in = F.array(
        F.struct(F.col("id").alias("thread_id"), F.lit(OWN_COMMENT).alias("show_type")),
        F.struct(F.col("parent_id").alias("thread_id"), F.lit(OWN_COMMENT_REPLY).alias("show_type")),
    )
    own_and_replies = (
        comments.withColumn("shown", F.explode(shown_in))
        .filter(F.col("shown.thread_id").isNotNull())
        .select("shown.*", *CARD)
    )
    above = tables.comments.select(F.col("id").alias("thread_id"), "post_id", "parent_id")

    def looked_up(key: str, found: DataFrame, show_type: str, sized_by: DataFrame) -> DataFrame:
        asked = above.filter(F.col(key).isNotNull()).select("thread_id", F.col(key).alias("id"))
        joined = many_to_one(asked, found.select(*CARD), ["id"], sized_by=sized_by)
        return joined.select("thread_id", F.lit(show_type).alias("show_type"), *CARD)

    posts = looked_up("post_id", cards(tables, POST, viewer), OWN_COMMENT_POST, tables.posts)
    parents = looked_up("parent_id", comments, PARENT_COMMENT, tables.comments)
    return own_and_replies.unionByName(posts).unionByName(parents)


def nested_threads(threads: DataFrame) -> DataFrame:
    """Comment lists of ``post_threads_all`` or ``comment_threads_all`` rows, nested.

    One row per thread and part, see ``operators.nesting.nest``.
    """
    flat = [c for c in CARD if not c.startswith("author_")]
    listed = threads.filter(F.col("show_type").isin(COMMENT, OWN_COMMENT_REPLY)).withColumn("author", author_record())
    return nest(listed, "thread_id", [*flat, "author"], "comments")


DETAIL = ("part", *PLAIN, "current_user_following")


def _details(
    tables: Tables, rows: DataFrame, viewer: int | None, followed_parts: list[str], first: Column
) -> DataFrame:
    entries = pin(rows)
    follows = F.when(F.col("show_type").isin(followed_parts), F.col("user_followed"))
    shown = plain_entries(tables, entries, viewer).withColumn("current_user_following", follows)
    parts = shown.withColumnRenamed("show_type", "part").select(*DETAIL)
    return in_order(parts, entries.small, first, F.desc("created_at"), F.desc("id"))


def post_detail(tables: Tables, post: int, viewer: int | None = None) -> DataFrame:
    """A post and its top-level comments as plain rows, newest comment first."""
    own = rows_at(tables, "posts", "id", post)
    top_level = rows_at(tables, "comments", "post_id", post).filter(F.col("parent_id").isNull())
    entries = _tagged(own, POST, POST).unionByName(_tagged(top_level, COMMENT, COMMENT))
    return _details(tables, entries, viewer, [POST], F.desc("part"))


def comment_detail(tables: Tables, comment: int, viewer: int | None = None) -> DataFrame:
    """A comment, its post, its parent and its replies as plain rows."""
    thread = thread_around(tables, comment)
    own = _around(thread.filter(F.col("id") == comment))
    replies = thread.filter(F.col("parent_id") == comment)
    entries = own.unionByName(_tagged(replies, COMMENT, OWN_COMMENT_REPLY))
    return _details(tables, entries, viewer, [OWN_COMMENT, OWN_COMMENT_POST], F.asc("part"))


def _plain_record() -> Column:
    return F.struct("id", "text", "created_at", "comment_count", author_record().alias("author"))


def user_comments(tables: Tables, author: int) -> DataFrame:
    """Every comment and reply of one author with its post and parent nested."""
    mine = tables.comments.filter(F.col("author_id") == author)
    entries = pin(_around(mine, "comment_id"))
    shown = _one_row_per_comment(plain_entries(tables, entries, None))
    return in_order(shown, entries.small, F.desc("comment.created_at"), F.desc("comment_id"))


def user_comments_all(tables: Tables) -> DataFrame:
    """``user_comments`` of every author; one row per comment, not sorted.

    Parents go to their replies, both to the comments, and these to the posts, in steps.
    """
    step = steps(tables)
    posts = plain_messages(tables, posts_as_messages(tables.posts)).select(
        F.col("id").alias("post_id"), _plain_record().alias("post")
    )

    def with_own() -> DataFrame:
        plain = step(lambda: plain_messages(tables, comments_as_messages(tables.comments)), "id")
        parents = plain.select(F.col("id").alias("parent_id"), _plain_record().alias("parent"))
        above = step(lambda: with_parents(tables, parents))
        comments = plain.select("author_id", F.col("id").alias("comment_id"), _plain_record().alias("comment"))
        return above.join(comments, "comment_id")

    joined = many_to_one(step(with_own), posts, ["post_id"], hot_from=tables.comments, sized_by=tables.posts)
    return joined.select("author_id", "comment_id", "comment", "post", "parent")


def _one_row_per_comment(rows: DataFrame) -> DataFrame:
    """Route the at most three rows of a comment into one row of records."""

    def part(tag: str, name: str) -> Column:
        return F.max(F.when(F.col("show_type") == tag, _plain_record())).alias(name)

    return rows.groupBy("comment_id").agg(
        part(OWN_COMMENT, "comment"), part(OWN_COMMENT_POST, "post"), part(PARENT_COMMENT, "parent")
    )


def flat_user_comments(nested: DataFrame) -> DataFrame:
    """The records of ``user_comments`` as flat columns, prefixed by their part."""
    columns = []
    for part in ("comment", "post", "parent"):
        for field in ("id", "text", "created_at", "comment_count"):
            columns.append(F.col(f"{part}.{field}").alias(f"{part}_{field}"))
        for field in ("id", "username", "display_name"):
            columns.append(F.col(f"{part}.author.{field}").alias(f"{part}_author_{field}"))
    return nested.select(*columns)
