"""Plain post lists and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.messages import posts_as_messages
from agora.operators.pinning import in_order, pin
from agora.operators.plain import PLAIN, plain_entries, plain_messages
from agora.schema import POST, Tables


def post_list(tables: Tables) -> DataFrame:
    """All posts with author and comment count, newest first."""
    rows = plain_messages(tables, posts_as_messages(tables.posts))
    return rows.select(*PLAIN).orderBy(F.desc("created_at"), F.desc("id"))


def author_posts(tables: Tables, author: int) -> DataFrame:
    """``post_list`` of one author; empty for an unknown one."""
    mine = tables.posts.filter(F.col("author_id") == author)
    entries = pin(mine.select(F.lit(POST).alias("kind"), "id"))
    rows = plain_entries(tables, entries, None).select(*PLAIN)
    return in_order(rows, entries.small, F.desc("created_at"), F.desc("id"))


def top_level_comments(tables: Tables) -> DataFrame:
    return tables.comments.filter(F.col("parent_id").isNull())


def reply_comments(tables: Tables) -> DataFrame:
    return tables.comments.filter(F.col("parent_id").isNotNull())


def confirmed_users(tables: Tables) -> DataFrame:
    return tables.users.filter(F.col("confirmed_at").isNotNull())


def unconfirmed_users(tables: Tables) -> DataFrame:
    return tables.users.filter(F.col("confirmed_at").isNull())
