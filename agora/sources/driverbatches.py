"""Request batches for the table jobs, derived from the whole test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.schema import COMMENT_LIKE, COMMENT_REPOST, POST_LIKE, POST_REPOST
from agora.sources.driverdata import events, plus_micros, source

# New rows get ids and requests get numbers past the stored ones.
BILLION = 1_000_000_000


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _at(day: str, micros: Column) -> Column:
    return plus_micros(F.lit(f"{day} 00:00:00").cast("timestamp_ntz"), micros)


def _event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.when(F.col("value") < 20, "delete").otherwise("insert").alias("action"),
        (F.col("event_id") + 1 + BILLION).alias("id"),
        (F.col("user_id") + 1).alias("user_id"),
        "event_type",
        "k",
        F.col("ts").alias("created_at"),
    )


def follow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks its user to follow, or no longer to follow, user k + 1."""
    return _event_requests(spark, sf_dir).select(
        "seq", "action", "id", F.col("user_id").alias("follower_id"), (F.col("k") + 1).alias("followee_id"), "created_at"
    )


def _mark_requests(spark: SparkSession, sf_dir: str, post_type: str, comment_type: str) -> DataFrame:
    on_post = F.col("event_type").isin("click", "view")
    return _event_requests(spark, sf_dir).select(
        "seq",
        "action",
        "id",
        F.when(on_post, post_type).otherwise(comment_type).alias("type"),
        "user_id",
        F.when(on_post, F.col("k") + 1).otherwise(F.col("k") * 8 + 1).alias("message_id"),
        "created_at",
    )


def like_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for a like, or its removal; some comments do not exist."""
    return _mark_requests(spark, sf_dir, POST_LIKE, COMMENT_LIKE)


def repost_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mark_requests(spark, sf_dir, POST_REPOST, COMMENT_REPOST)


def new_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per part, some by unknown authors, and every document as it is."""
    part = F.col("p_partkey")
    asked = source(spark, sf_dir, "part").select(
        part.alias("seq"),
        (part + 1 + BILLION).alias("id"),
        _text("Would you buy a ", F.col("p_name"), "?").alias("text"),
        (part + 1).alias("author_id"),
        _at("2024-03-01", part).alias("created_at"),
    )
    doc = F.col("doc_id")
    documents = source(spark, sf_dir, "documents").select(
        (doc + BILLION).alias("seq"),
        (doc + 1 + 2 * BILLION).alias("id"),
        "text",
        (doc + 1).alias("author_id"),
        _at("2024-03-02", doc).alias("created_at"),
    )
    return asked.unionByName(documents)


def new_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment per event and a chain of replies to it, some refused.

    Some parents are missing, on another post, refused themselves or later in
    the batch.
    """
    ending = F.when(F.col("event_type") == "error", "!").otherwise("?")
    parent = (
        F.when(F.col("event_type") == "click", F.col("k") * 8 + 1)
        .when(F.col("event_type") == "purchase", (F.col("k") + 1) * 8 + 1)
        .when(F.col("event_type") == "signup", F.col("k") * 8 + 2)
    )
    made = events(spark, sf_dir)
    first = made.select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") + 1 + BILLION).alias("id"),
        _text("Is event ", F.col("event_id"), " a ", F.col("event_type"), ending).alias("text"),
        (F.col("k") + 1).alias("post_id"),
        (F.col("user_id") + 1).alias("author_id"),
        parent.alias("parent_id"),
        F.col("ts").alias("created_at"),
    )
    # Replies to the comment, to that reply (on another post for errors), and one that comes before its parent.
    for level in (2, 3, 4):
        other_post = (F.col("event_type") == "purchase").cast("long") if level == 3 else F.lit(0)
        replies = made.select(
            (F.col("event_id") + level * BILLION).alias("seq") if level < 4 else (-F.col("event_id") - 1).alias("seq"),
            (F.col("event_id") + 1 + level * BILLION).alias("id"),
            _text("Is ", F.col("event_id"), f" at level {level}?").alias("text"),
            (F.col("k") + 1 + other_post).alias("post_id"),
            (F.col("user_id") + 1).alias("author_id"),
            (F.col("event_id") + 1 + (level - 1) * BILLION).alias("parent_id"),
            F.col("ts").alias("created_at"),
        )
        first = first.unionByName(replies)
    return first


def post_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit per order and one per part; not all by the author, valid, or of a post."""
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    orders = source(spark, sf_dir, "orders").select(
        key.alias("seq"),
        F.when(status == "F", F.col("o_custkey") + 2).otherwise(F.col("o_custkey") + 1).alias("actor_id"),
        (key + 1).alias("id"),
        F.when(status == "P", _text("Order ", key, " is pending."))
        .otherwise(_text("Was order ", key, " changed?"))
        .alias("text"),
    )
    part = F.col("p_partkey")
    parts = source(spark, sf_dir, "part").select(
        (part + BILLION).alias("seq"),
        (part + 1).alias("actor_id"),
        (part + BILLION).alias("id"),
        _text("Is ", F.col("p_name"), " lost?").alias("text"),
    )
    return orders.unionByName(parts)


def comment_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit per line, by the author where it was returned."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = source(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity")
    )
    author = F.expr("part * 3 div 4") + 1
    return rows.select(
        line.alias("seq"),
        F.when(F.col("flag") == "R", author).otherwise(author + 1).alias("actor_id"),
        line.alias("id"),
        _text("Was it ", F.col("quantity").cast("long"), F.when(F.col("quantity") > 45, ".").otherwise(""), "?").alias(
            "text"
        ),
    )


def new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign-up per supplier, nation, part and customer; few pass all rules."""
    supplier = F.col("s_suppkey")
    suppliers = source(spark, sf_dir, "supplier").select(
        supplier.alias("seq"),
        F.regexp_replace("s_name", "#", "_").alias("username"),
        _text("supplier", F.col("s_nationkey"), "@example.com").alias("email"),
        F.col("s_name").alias("display_name"),
    )
    nation = F.col("n_nationkey").cast("long")
    nations = source(spark, sf_dir, "nation").select(
        (nation + BILLION).alias("seq"),
        F.col("n_name").alias("username"),
        _text("Nation", nation, "@Example.com").alias("email"),
        F.col("n_name").alias("display_name"),
    )
    part = F.col("p_partkey")
    parts = source(spark, sf_dir, "part").select(
        (part + 2 * BILLION).alias("seq"),
        F.col("p_name").alias("username"),
        _text("part", part, "@example").alias("email"),
        F.lit(" ").alias("display_name"),
    )
    customer = F.col("c_custkey")
    customers = source(spark, sf_dir, "customer").select(
        (customer + 3 * BILLION).alias("seq"),
        F.upper(F.regexp_replace("c_name", "#", "_")).alias("username"),
        _text("again", customer, "@example.com").alias("email"),
        _text("Again ", customer).alias("display_name"),
    )
    every = suppliers.unionByName(nations).unionByName(parts).unionByName(customers)
    return every.select(
        "seq",
        (F.col("seq") + 1 + BILLION).alias("id"),
        "username",
        "email",
        "display_name",
        _at("2024-03-01", F.col("seq")).alias("created_at"),
    )


def user_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit per customer; some of another account, some for a contested email."""
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    return source(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.when(F.col("c_acctbal") < 0, key + 2).otherwise(key + 1).alias("actor_id"),
        (key + 1).alias("id"),
        F.when(segment != "BUILDING", _text(F.lower(segment), " ", key)).alias("display_name"),
        F.when(segment == "MACHINERY", _text("User", F.col("c_nationkey"), "@example.com"))
        .when(segment == "FURNITURE", _text("customer_", key, "@example"))
        .alias("email"),
    )


def _customer_email(key: Column) -> Column:
    """The email a customer signed up with."""
    return F.concat(F.lit("customer_"), F.lpad(key.cast("string"), 9, "0"), F.lit("@example.com"))


def moving_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two email changes per customer, in chains.

    First each takes the email of the customer before, which is free if that one has
    just moved; machinery customers take a new one, and those in debt are refused as
    strangers.  Then some go back to the email they came from, others to one of few.
    """
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    first = F.when(segment == "MACHINERY", _text("Moved", key, "@example.com")).otherwise(_customer_email(key - 1))
    second = F.when(segment.isin("AUTOMOBILE", "BUILDING"), _customer_email(key)).otherwise(
        _text("shared", F.col("c_nationkey"), "@example.com")
    )
    actor = F.when(F.col("c_acctbal") < 0, key + 2).otherwise(key + 1)
    moves = F.array(
        F.struct(key.alias("seq"), actor.alias("actor_id"), first.alias("email")),
        F.struct((key + BILLION).alias("seq"), (key + 1).alias("actor_id"), second.alias("email")),
    )
    rows = source(spark, sf_dir, "customer").select((key + 1).alias("id"), F.explode(moves).alias("move"))
    return rows.select("move.seq", "move.actor_id", "id", F.lit(None).cast("string").alias("display_name"), "move.email")


def contesting_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign-up per customer; neighbours share a username or an email by turns, in one long chain."""
    key = F.col("c_custkey")
    return source(spark, sf_dir, "customer").select(
        key.alias("seq"),
        (key + 1 + BILLION).alias("id"),
        _text("Rival", F.floor(key / 2)).alias("username"),
        _text("rival", F.floor((key + 1) / 2), "@Example.com").alias("email"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" ")).otherwise(F.lit("Rival")).alias("display_name"),
        _at("2024-03-01", key).alias("created_at"),
    )


def mixed_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confirmation per customer, and one per supplier, who are no users."""
    strangers = source(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + BILLION).alias("id"), _at("2024-01-01", F.col("s_suppkey")).alias("confirmed_at")
    )
    return confirmations(spark, sf_dir).unionByName(strangers)


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return source(spark, sf_dir, "customer").select(
        (key + 1).alias("id"), _at("2024-01-01", key).alias("confirmed_at")
    )


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term per customer, part, supplier and nation: literal ones, wildcards, percent signs, one letter."""
    customer, part, supplier = F.col("c_custkey"), F.col("p_partkey"), F.col("s_suppkey")
    every = (
        source(spark, sf_dir, "customer").select(_text("ORDER ", customer, " ").alias("term")),
        source(spark, sf_dir, "part").select(_text("er ", part, " _-").alias("term")),
        source(spark, sf_dir, "supplier").select(_text(supplier, "% urgent").alias("term")),
        source(spark, sf_dir, "nation").select(F.substring("n_name", 1, 1).alias("term")),
    )
    return reduce(DataFrame.unionByName, every)


def people_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term per part, supplier and nation, for usernames and display names."""
    part, supplier = F.col("p_partkey"), F.col("s_suppkey")
    every = (
        source(spark, sf_dir, "part").select(_text("0", part).alias("term")),
        source(spark, sf_dir, "supplier").select(_text("machinery ", supplier).alias("term")),
        source(spark, sf_dir, "supplier").select(_text("_omer_0", supplier, "%").alias("term")),
        source(spark, sf_dir, "nation").select(F.col("n_name").alias("term")),
    )
    return reduce(DataFrame.unionByName, every)


def post_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion per order, by the author where the order is open, and one per part."""
    orders = source(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") + 1)
        .otherwise(F.col("o_custkey") + 2)
        .alias("actor_id"),
        (F.col("o_orderkey") + 1).alias("id"),
    )
    parts = source(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("actor_id"), (F.col("p_partkey") + BILLION).alias("id")
    )
    return orders.unionByName(parts)


def comment_deletions(comments: DataFrame) -> DataFrame:
    """A deletion per comment, by the author where the line was returned."""
    returned = F.col("text").endswith("R?")
    return comments.select(
        F.when(returned, F.col("author_id")).otherwise(F.col("author_id") + 1).alias("actor_id"), "id"
    )
