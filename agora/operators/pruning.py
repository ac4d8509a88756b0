"""Reading only the buckets of the stored tables that a request can touch.

A request names its messages in a computed frame of (kind, id).  The buckets of those
ids are joined to the bucket column of a table, which is a partition column: the scan
takes its partitions from that side of the join when it runs.  The frames that come
back hold whole buckets, so they stand in for the tables in any join by message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.pinning import Pinned, pin
from agora.schema import COMMENT, POST, Tables
from agora.sources.stored import BUCKET, BUCKET_KEY, bucket_of

# With more messages than this for each bucket, hardly a bucket is left out.
PER_BUCKET = 2

_THREAD, _MESSAGE = "thread", "message"


def _in_buckets(stored: DataFrame, buckets: DataFrame) -> DataFrame:
    return stored.join(F.broadcast(buckets), BUCKET, "left_semi").drop(BUCKET)


def rows_at(tables: Tables, name: str, column: str, value: int) -> DataFrame:
    """The rows of a table with one value; of one bucket, if the table is cut by that column."""
    wanted = F.col(column) == value
    layout = tables.layout
    if layout is None or not layout.knows(name) or BUCKET_KEY[name] != column:
        return getattr(tables, name).filter(wanted)
    bucket = bucket_of(F.lit(value), layout.buckets)
    return layout.frames[name].filter((F.col(BUCKET) == bucket) & wanted).drop(BUCKET)


def thread_around(tables: Tables, comment: int) -> DataFrame:
    """Comments among which are all on the post of one comment, found by the index of comments."""
    layout = tables.layout
    if layout is None or not layout.knows("comments"):
        return tables.comments
    own = (F.col(BUCKET) == bucket_of(F.lit(comment), layout.buckets)) & (F.col("id") == comment)
    thread = layout.index.filter(own).select(bucket_of(F.col("post_id"), layout.buckets).alias(BUCKET))
    return _in_buckets(layout.frames["comments"], thread)


def near(tables: Tables, entries: Pinned) -> Tables:
    """Tables that hold all that a request about the computed (kind, id) ``entries`` looks up.

    Likes and reposts are cut by message, posts by id, and comments by post, so the
    replies, parents and posts of a comment lie in the bucket of its thread.  Follows and
    users stay as they are.
    """
    layout = tables.layout
    known = layout is not None and layout.knows("posts", "comments", "likes", "reposts")
    if not known or entries.rows > PER_BUCKET * layout.buckets:
        return tables

    def bucket(column: str, role: str):
        return lambda ids: ids.select(F.lit(role).alias("role"), bucket_of(F.col(column), layout.buckets).alias(BUCKET))

    on_posts = entries.frame.filter(F.col("kind") == POST).select("id")
    on_comments = entries.frame.filter(F.col("kind") == COMMENT).select("id").distinct()
    indexed = _in_buckets(layout.index, bucket("id", _MESSAGE)(on_comments).select(BUCKET))
    posts_of_comments = indexed.join(F.broadcast(on_comments), "id").select("post_id")
    places = pin(
        bucket("id", _MESSAGE)(entries.frame)
        .unionByName(bucket("id", _THREAD)(on_posts))
        .unionByName(bucket("post_id", _THREAD)(posts_of_comments))
        .distinct()
    )

    def narrowed(name: str, role: str) -> DataFrame:
        return _in_buckets(layout.frames[name], places.frame.filter(F.col("role") == role).select(BUCKET))

    return tables.with_(
        posts=narrowed("posts", _THREAD),
        comments=narrowed("comments", _THREAD),
        likes=narrowed("likes", _MESSAGE),
        reposts=narrowed("reposts", _MESSAGE),
    )
