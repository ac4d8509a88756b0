"""The six tables mapped from the TPC-H-like test data.

Every id is the source key + 1, since 0 stands for "no viewer".
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.operators.grams import text_index, write_index
from agora.operators.joins import many_to_one
from agora.schema import COMMENT, COMMENT_LIKE, COMMENT_REPOST, POST, POST_LIKE, POST_REPOST, GramIndex, Tables
from agora.session import shared_dir
from agora.operators.pinning import pin
from agora.sources.stored import BUCKET, bucket_of, conform, read_bucketed, read_table, with_stored, write_bucketed, write_layout

# Which event type stands for which edge.
LIKE_EVENTS = {"click": POST_LIKE, "purchase": COMMENT_LIKE}
REPOST_EVENTS = {"view": POST_REPOST, "error": COMMENT_REPOST}
FOLLOW_EVENT = "signup"
COMMENT_EDGES = (COMMENT_LIKE, COMMENT_REPOST)
USER = "User"
# Buckets of the mapped tables; more for more data, so that one stays some hundred MB.
BUCKETS = 16


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ts)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    username = F.regexp_replace("c_name", "#", "_")
    key = F.col("c_custkey")
    epoch = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    return source(spark, sf_dir, "customer").select(
        (key + 1).alias("id"),
        username.alias("username"),
        F.concat(F.lower(username), F.lit("@example.com")).alias("email"),
        F.concat_ws(" ", "c_mktsegment", key.cast("string")).alias("display_name"),
        plus_micros(epoch, key).alias("created_at"),
        F.when(F.col("c_acctbal") >= 0, plus_micros(epoch, key + 1_000_000)).alias("confirmed_at"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return source(spark, sf_dir, "orders").select(
        (key + 1).alias("id"),
        F.concat(F.lit("Is order "), key.cast("string"), F.lit(" "), "o_orderpriority", F.lit("?")).alias("text"),
        (F.col("o_custkey") + 1).alias("author_id"),
        plus_micros(F.col("o_orderdate"), key).alias("created_at"),
    )


def _comment_id() -> Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comment per (order, line number); even lines reply to the line before.

    The window runs over one order, which has at most 7 line numbers.  Lines are dealt
    once, by the bucket of their post and a share of its orders, which serves the grouping,
    the window and the writing alike.
    """
    shares = -(-int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // BUCKETS)
    place = [BUCKET, "share"]
    lines = (
        source(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
        .withColumn(BUCKET, bucket_of(F.col("l_orderkey") + 1, BUCKETS))
        .withColumn("share", F.pmod(F.xxhash64("l_orderkey"), F.lit(shares)))
        .repartition(*place)
        .groupBy(*place, "l_orderkey", "l_linenumber")
        .agg(
            F.min("l_partkey").alias("part"),
            F.min("l_returnflag").alias("flag"),
            F.min("l_shipdate").alias("shipped"),
        )
        .withColumn("id", _comment_id())
        .withColumn("post_id", F.col("l_orderkey") + 1)
    )
    before = F.lag("id").over(Window.partitionBy(*place, "l_orderkey").orderBy("l_linenumber"))
    text = F.concat(
        F.lit("Was line "), F.col("l_linenumber").cast("string"), F.lit(" of "),
        F.col("post_id").cast("string"), F.lit(" returned "), F.col("flag"), F.lit("?"),
    )
    return lines.select(
        "id",
        text.alias("text"),
        "post_id",
        (F.expr("part * 3 div 4") + 1).alias("author_id"),
        F.when(F.col("l_linenumber") % 2 == 0, before).alias("parent_id"),
        plus_micros(F.col("shipped"), F.col("id")).alias("created_at"),
    )


def events(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """(event_id, ts, user_id, event_type, value, k) with k the number inside props."""
    rows = source(spark, sf_dir, "events")
    if kinds is not None:
        rows = rows.filter(F.col("event_type").isin(kinds))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return rows.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))


def first_comments(comments_: DataFrame) -> DataFrame:
    """(post_id, first_comment) for posts that have a comment."""
    return comments_.groupBy("post_id").agg(F.min("id").alias("first_comment"))


def _once(edges: DataFrame, key: list[str]) -> DataFrame:
    """The earliest of the edges that share a key."""
    return edges.groupBy(*key).agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts"))


def message_edges(
    spark: SparkSession, sf_dir: str, kinds: dict[str, str], comments_: DataFrame, distinct: bool
) -> DataFrame:
    """Like or repost edges; with ``distinct`` only the earliest of equal ones."""
    marked = events(spark, sf_dir, list(kinds)).select(
        "event_id",
        "ts",
        (F.col("user_id") + 1).alias("user_id"),
        (F.col("k") + 1).alias("post_id"),
        reduce(lambda c, e: c.when(F.col("event_type") == e, kinds[e]), kinds, F).alias("type"),
    )
    if distinct:
        marked = _once(marked, ["type", "user_id", "post_id"])
    marked = pin(marked).frame
    on_comment = F.col("type").isin(*COMMENT_EDGES)
    on_posts = marked.filter(~on_comment).withColumn("message_id", F.col("post_id"))
    first = first_comments(comments_).withColumnRenamed("first_comment", "message_id")
    asked = marked.filter(on_comment)
    on_comments = many_to_one(asked, first, ["post_id"], sized_by=comments_, few_from=asked)
    return on_posts.unionByName(on_comments).select(
        (F.col("event_id") + 1).alias("id"), "type", "user_id", "message_id", F.col("ts").alias("created_at")
    )


def follow_edges(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    marked = events(spark, sf_dir, [FOLLOW_EVENT]).select(
        "event_id", "ts", (F.col("user_id") + 1).alias("follower_id"), (F.col("k") + 1).alias("followee_id")
    )
    if distinct:
        marked = _once(marked, ["follower_id", "followee_id"])
    return marked.select(
        (F.col("event_id") + 1).alias("id"), "follower_id", "followee_id", F.col("ts").alias("created_at")
    )


def without_own_reposts(edges: DataFrame, posts_: DataFrame, comments_: DataFrame) -> DataFrame:
    """Drop reposts of the reposter's own posts and comments."""

    def kept(tag: str, messages: DataFrame) -> DataFrame:
        authors = messages.select(F.col("id").alias("message_id"), "author_id")
        asked = edges.filter(F.col("type") == tag)
        of_kind = many_to_one(asked, authors, ["message_id"], few_from=asked)
        return of_kind.filter(F.col("author_id") != F.col("user_id")).drop("author_id")

    return kept(POST_REPOST, posts_).unionByName(kept(COMMENT_REPOST, comments_))


def raw_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The mapping before repeated edges, self-follows and own reposts are dropped."""
    stored = load(spark, sf_dir)
    return stored.with_(
        likes=conform(message_edges(spark, sf_dir, LIKE_EVENTS, stored.comments, distinct=False), "likes"),
        reposts=conform(message_edges(spark, sf_dir, REPOST_EVENTS, stored.comments, distinct=False), "reposts"),
        follows=conform(follow_edges(spark, sf_dir, distinct=False), "follows"),
    )


def ingest(spark: SparkSession, sf_dir: str) -> str:
    """Write the mapped tables to the shared folder; returns where.

    Users, posts and comments come first; the edges are then derived from the
    stored messages, so that nothing is mapped twice.
    """
    path = f"{shared_dir(spark).rstrip('/')}/agora-tables-{uuid.uuid4().hex}"

    def write(frame: DataFrame, name: str, dealt: bool = False) -> None:
        write_bucketed(frame, name, path, BUCKETS, dealt=dealt)

    write_layout(spark, path, BUCKETS)
    write(users(spark, sf_dir), "users")
    write(posts(spark, sf_dir), "posts")
    write(comments(spark, sf_dir), "comments", dealt=True)
    posts_, comments_ = read_table(spark, "posts", path), read_table(spark, "comments", path)
    likes = message_edges(spark, sf_dir, LIKE_EVENTS, comments_, distinct=True)
    reposts = pin(message_edges(spark, sf_dir, REPOST_EVENTS, comments_, distinct=True)).frame
    follows = follow_edges(spark, sf_dir, distinct=True)
    write(likes, "likes")
    write(without_own_reposts(reposts, posts_, comments_), "reposts")
    write(follows.filter(F.col("follower_id") != F.col("followee_id")), "follows")
    return path


_indexes: dict[tuple[str, str, str], GramIndex] = {}


def gram_index(spark: SparkSession, sf_dir: str, kind: str) -> GramIndex:
    """The gram index of the posts, comments or users, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _indexes:
        tables = load(spark, sf_dir)
        rows, columns = {
            POST: (tables.posts, ["text"]),
            COMMENT: (tables.comments, ["text"]),
            USER: (tables.users, ["username", "display_name"]),
        }[kind]
        path = f"{shared_dir(spark).rstrip('/')}/agora-grams-{uuid.uuid4().hex}"
        write_index(text_index(rows, columns), path, BUCKETS)
        frame = spark.read.schema(f"id long, gram string, {BUCKET} int").parquet(path)
        _indexes[key] = GramIndex(frame, BUCKETS)
    return _indexes[key]


def own_copy(spark: SparkSession, sf_dir: str, name: str) -> tuple[Tables, str]:
    """The mapped tables with one of them written anew, to be changed in place, and where it lies."""
    tables = load(spark, sf_dir)
    path = f"{shared_dir(spark).rstrip('/')}/agora-tables-{uuid.uuid4().hex}"
    write_bucketed(getattr(tables, name), name, path, BUCKETS)
    return with_stored(spark, tables, name, path), path


_ingested: dict[tuple[str, str], Tables] = {}


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The mapped tables, written once per application and read from then on.

    Comments and edges come out of aggregations; without this every query would
    repeat those for each use of a table.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingested:
        _ingested[key] = read_bucketed(spark, ingest(spark, sf_dir))
    return _ingested[key]
