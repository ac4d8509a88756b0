"""Details of all posts and comments as nested records of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.joins import many_to_one
from agora.operators.messages import author_record, comments_as_messages, posts_as_messages, steps, with_followed
from agora.operators.nesting import nest
from agora.operators.plain import plain_messages, with_parents
from agora.schema import Tables

_FIELDS = ("id", "text", "created_at", "comment_count")


def _record(*more: str) -> Column:
    """A message as it is shown below others: without marks, its author nested."""
    return F.struct(*_FIELDS, author_record().alias("author"), *more)


def _lists(messages: DataFrame, owner: str, name: str) -> DataFrame:
    """(owner, part, parts, ``name``): the messages of each owner, newest first."""
    listed = messages.withColumn("author", author_record())
    return nest(listed, owner, [*_FIELDS, "author"], name)


def _with_lists(owners: DataFrame, lists: DataFrame, key: str, name: str) -> DataFrame:
    """Each owner once for every part of its list; one without a list has an empty part 0 of none."""
    joined = owners.join(lists, key, "left")
    empty = F.array().cast(lists.schema[name].dataType)
    return joined.withColumns(
        {"part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(0)), name: F.coalesce(name, empty)}
    )


def post_details_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """(post_id, part, parts, post, comments): every post with its top-level comments, newest first.

    ``post`` says whether the viewer follows its author.  A row holds at most a part of
    the list, see ``operators.nesting.nest``, so no record grows with its thread.
    """
    posts = with_followed(tables, plain_messages(tables, posts_as_messages(tables.posts)), viewer)
    posts = posts.withColumnRenamed("user_followed", "current_user_following")
    owners = posts.select(F.col("id").alias("post_id"), _record("current_user_following").alias("post"))
    top_level = comments_as_messages(tables.comments).filter(F.col("parent_id").isNull())
    lists = _lists(plain_messages(tables, top_level), "post_id", "comments")
    return _with_lists(owners, lists, "post_id", "comments").select("post_id", "part", "parts", "post", "comments")


def comment_details_all(tables: Tables, viewer: int | None = None) -> DataFrame:
    """(comment_id, part, parts, comment, post, parent, replies): every comment with all around it.

    ``comment`` and ``post`` say whether the viewer follows their authors; ``parent`` is
    null for a top-level comment; replies come newest first, in parts.
    """
    step = steps(tables)
    posts = with_followed(tables, plain_messages(tables, posts_as_messages(tables.posts)), viewer)
    posts = posts.withColumnRenamed("user_followed", "current_user_following")
    of_post = posts.select(F.col("id").alias("post_id"), _record("current_user_following").alias("post"))

    def with_own() -> DataFrame:
        comments = step(lambda: plain_messages(tables, comments_as_messages(tables.comments)), "id")
        replies = comments.filter(F.col("parent_id").isNotNull())
        lists = _lists(replies, "parent_id", "replies").withColumnRenamed("parent_id", "comment_id")
        as_parent = comments.select(F.col("id").alias("parent_id"), _record().alias("parent"))
        above = step(lambda: with_parents(tables, as_parent))
        marked = with_followed(tables, comments, viewer).withColumnRenamed("user_followed", "current_user_following")
        own = marked.select(F.col("id").alias("comment_id"), _record("current_user_following").alias("comment"))
        return _with_lists(above.join(own, "comment_id"), lists, "comment_id", "replies")

    rows = many_to_one(step(with_own), of_post, ["post_id"], hot_from=tables.comments, sized_by=tables.posts)
    return rows.select("comment_id", "part", "parts", "comment", "post", "parent", "replies")


def _flat(record: str, fields: tuple[str, ...] = _FIELDS) -> list[Column]:
    columns = [F.col(f"{record}.{field}").alias(f"{record}_{field}") for field in fields]
    return [*columns, *[F.col(f"{record}.author.{f}").alias(f"{record}_author_{f}") for f in ("id", "username", "display_name")]]


def flat_post_details(details: DataFrame) -> DataFrame:
    """One row per post and comment in its list; a post without comments has one with none."""
    rows = details.select("part", "parts", "post", F.posexplode_outer("comments").alias("position", "comment"))
    marks = (*_FIELDS, "current_user_following")
    return rows.select("part", "parts", "position", *_flat("post", marks), *_flat("comment"))


def flat_comment_details(details: DataFrame) -> DataFrame:
    """One row per comment and reply in its list; a comment without replies has one with none."""
    rows = details.select("*", F.posexplode_outer("replies").alias("position", "reply"))
    marks = (*_FIELDS, "current_user_following")
    flat = [*_flat("comment", marks), *_flat("post", marks), *_flat("parent"), *_flat("reply")]
    return rows.select("part", "parts", "position", *flat)
