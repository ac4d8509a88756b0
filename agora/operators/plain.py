"""Plain message rows: text, comment count and author, without likes or reposts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.engagement import MESSAGE_KEY, counted_for
from agora.operators.joins import many_to_one
from agora.operators.messages import few_with_authors, messages, names, with_followed
from agora.operators.pinning import Pinned
from agora.operators.pruning import near
from agora.schema import COMMENT, POST, Tables

PLAIN = ("id", "text", "created_at", "comment_count", "author_id", "author_username", "author_display_name")


def comment_counts(tables: Tables, only: Pinned | None = None) -> DataFrame:
    """(kind, id, comment_count): top-level comments of posts, direct replies of comments."""
    below = counted_for(tables, POST, COMMENT)
    if only is None or not only.small:
        return below.groupBy(*MESSAGE_KEY).agg(F.count(F.lit(1)).alias("comment_count"))
    wanted = below.join(only.hinted(*MESSAGE_KEY), MESSAGE_KEY, "left_semi")
    return F.broadcast(wanted.groupBy(*MESSAGE_KEY).agg(F.count(F.lit(1)).alias("comment_count")))


def plain_messages(tables: Tables, rows: DataFrame) -> DataFrame:
    """Any number of message rows with comment counts and authors."""
    counted = rows.join(comment_counts(tables), MESSAGE_KEY, "left").fillna(0, ["comment_count"])
    authors = names(tables).select(
        F.col("id").alias("author_id"),
        F.col("username").alias("author_username"),
        F.col("display_name").alias("author_display_name"),
    )
    return many_to_one(counted, authors, ["author_id"], hot_from=rows)


def with_parents(tables: Tables, parents: DataFrame) -> DataFrame:
    """(comment_id, post_id, parent): every comment, and the ``parent`` that ``parents`` has for its parent_id, or null.

    Only replies are moved.
    """
    comments = tables.comments.select(F.col("id").alias("comment_id"), "post_id", "parent_id")
    replies = comments.filter(F.col("parent_id").isNotNull())
    found = many_to_one(replies, parents, ["parent_id"], "left", hot_from=replies, sized_by=tables.comments)
    nothing = F.lit(None).cast(parents.schema["parent"].dataType).alias("parent")
    top_level = comments.filter(F.col("parent_id").isNull()).select("comment_id", "post_id", nothing)
    return found.select("comment_id", "post_id", "parent").unionByName(top_level)


def plain_entries(tables: Tables, entries: Pinned, viewer: int | None) -> DataFrame:
    """The messages that computed (kind, id, ...) entries name, as plain rows.

    ``user_followed`` says whether the viewer follows the author.
    """
    if not entries.small:
        every = plain_messages(tables, messages(tables))
        shown = many_to_one(entries.frame, every, MESSAGE_KEY, sized_by=messages(tables))
        return with_followed(tables, shown, viewer)
    tables = near(tables, entries)
    rows = messages(tables).join(entries.hinted(), MESSAGE_KEY)
    counted = rows.join(comment_counts(tables, entries), MESSAGE_KEY, "left").fillna(0, ["comment_count"])
    return with_followed(tables, few_with_authors(tables, counted), viewer)
