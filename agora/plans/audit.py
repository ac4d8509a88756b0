"""Integrity checks of whole tables.

Each check gives the offending rows or keys; ``summary`` counts them per rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.text import TEXT_BLANK, TEXT_NOT_QUESTION, TEXT_TOO_LONG, text_problems, user_problems
from agora.operators.engagement import MESSAGE_KEY, kind_of
from agora.operators.joins import many_to_one
from agora.operators.messages import messages
from agora.schema import COMMENT_REPOST, POST_REPOST, Tables

# What each rule reports.
USERNAME_TAKEN = "Username has already been taken"
EMAIL_TAKEN = "Email has already been taken"
REPLY_ON_OTHER_POST = "Reply and parent comment must be to the same post"
FOLLOWS_SELF = "Cannot follow self"
REPOSTS_OWN = "User cannot repost own content"
# Our names for rules that only the database enforces.
FOLLOW_REPEATED = "Follow already exists"
LIKE_REPEATED = "Like already exists"
REPOST_REPEATED = "Repost already exists"


def audit_messages(rows: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """(key, problems) of the rows whose text breaks a content rule."""
    key = key or ("id",)
    return rows.select(*key, text_problems(F.col(text)).alias("problems")).filter(F.size("problems") > 0)


TEXT_RULES = (TEXT_BLANK, TEXT_TOO_LONG, TEXT_NOT_QUESTION)


def audit_users(users: DataFrame) -> DataFrame:
    """(id, problems) of the users that break a format rule."""
    problems = user_problems(F.col("username"), F.col("email"), F.col("display_name"))
    return users.select("id", problems.alias("problems")).filter(F.size("problems") > 0)


def problem_counts(audited: DataFrame) -> DataFrame:
    """Rows per problem."""
    return (
        audited.select(F.explode("problems").alias("problem"))
        .groupBy("problem")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def normalise_users(users: DataFrame) -> DataFrame:
    """Users with their email in lower case."""
    return users.withColumn("email", F.lower("email"))


def repeated_keys(tables: Tables) -> DataFrame:
    """(rule, key, rows) for every key that must be unique and is not."""

    def repeated(rows: DataFrame, rule: str, *key) -> DataFrame:
        columns = [k.alias(f"k{i}") for i, k in enumerate(key)]
        counted = rows.select(*columns).groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.count(F.lit(1)).alias("rows"))
        shown = F.concat_ws("/", *[F.col(f"k{i}").cast("string") for i in range(len(key))])
        return counted.filter(F.col("rows") > 1).select(F.lit(rule).alias("rule"), shown.alias("key"), "rows")

    edge = [F.col("type"), F.col("user_id"), F.col("message_id")]
    checks = [
        repeated(tables.users, USERNAME_TAKEN, F.lower("username")),
        repeated(tables.users, EMAIL_TAKEN, F.lower("email")),
        repeated(tables.follows, FOLLOW_REPEATED, F.col("follower_id"), F.col("followee_id")),
        repeated(tables.likes, LIKE_REPEATED, *edge),
        repeated(tables.reposts, REPOST_REPEATED, *edge),
    ]
    return reduce(DataFrame.unionByName, checks)


UNIQUE_RULES = (USERNAME_TAKEN, EMAIL_TAKEN, FOLLOW_REPEATED, LIKE_REPEATED, REPOST_REPEATED)


def missing_references(tables: Tables) -> DataFrame:
    """(rule, kind, key, rows): keys that rows refer to and that do not exist.

    References are counted per key before they are looked up, so a key with any
    number of references is one row in the join.
    """
    users = tables.users.select(F.lit("User").alias("kind"), "id")
    existing = users.unionByName(messages(tables).select(*MESSAGE_KEY)).withColumn("exists", F.lit(True))

    def references(rows: DataFrame, rule, kind, key: str) -> DataFrame:
        return (
            rows.select(rule.alias("rule"), kind.alias("kind"), F.col(key).alias("id"))
            .filter(F.col("id").isNotNull())
            .groupBy("rule", *MESSAGE_KEY)
            .agg(F.count(F.lit(1)).alias("rows"))
        )

    def edges(rows: DataFrame, name: str) -> list[DataFrame]:
        message = F.concat(F.lit(f"{name}: "), kind_of(), F.lit(" must exist"))
        return [
            references(rows, F.lit(f"{name}: User must exist"), F.lit("User"), "user_id"),
            references(rows, message, kind_of(), "message_id"),
        ]

    user, post, comment = F.lit("User"), F.lit("Post"), F.lit("Comment")
    asked = [
        references(tables.posts, F.lit("Post: Author must exist"), user, "author_id"),
        references(tables.comments, F.lit("Comment: Author must exist"), user, "author_id"),
        references(tables.comments, F.lit("Comment: Post must exist"), post, "post_id"),
        references(tables.comments, F.lit("Comment: Parent must exist"), comment, "parent_id"),
        references(tables.follows, F.lit("Follow: Follower must exist"), user, "follower_id"),
        references(tables.follows, F.lit("Follow: Followee must exist"), user, "followee_id"),
        *edges(tables.likes, "Like"),
        *edges(tables.reposts, "Repost"),
    ]
    looked_up = reduce(DataFrame.unionByName, asked).join(existing, MESSAGE_KEY, "left")
    return looked_up.filter(F.col("exists").isNull()).select("rule", "kind", F.col("id").alias("key"), "rows")


REFERENCE_RULES = (
    "Post: Author must exist",
    "Comment: Author must exist",
    "Comment: Post must exist",
    "Comment: Parent must exist",
    "Follow: Follower must exist",
    "Follow: Followee must exist",
    "Like: User must exist",
    "Like: Post must exist",
    "Like: Comment must exist",
    "Repost: User must exist",
    "Repost: Post must exist",
    "Repost: Comment must exist",
)


def misplaced_replies(tables: Tables) -> DataFrame:
    """(rule, id) of replies whose parent is on another post."""
    parents = tables.comments.select(F.col("id").alias("parent_id"), F.col("post_id").alias("parent_post_id"))
    replies = tables.comments.filter(F.col("parent_id").isNotNull()).select("id", "post_id", "parent_id")
    joined = many_to_one(replies, parents, ["parent_id"])
    return joined.filter(F.col("post_id") != F.col("parent_post_id")).select(
        F.lit(REPLY_ON_OTHER_POST).alias("rule"), "id"
    )


def self_edges(tables: Tables) -> DataFrame:
    """(rule, id) of follows of oneself and reposts of own messages."""
    follows = tables.follows.filter(F.col("follower_id") == F.col("followee_id"))
    reposts = tables.reposts.filter(F.col("type").isin(POST_REPOST, COMMENT_REPOST)).select(
        F.col("id").alias("edge_id"), "user_id", kind_of().alias("kind"), F.col("message_id").alias("id")
    )
    authors = messages(tables).select(*MESSAGE_KEY, "author_id")
    own = many_to_one(reposts, authors, MESSAGE_KEY, sized_by=messages(tables)).filter(
        F.col("author_id") == F.col("user_id")
    )
    return follows.select(F.lit(FOLLOWS_SELF).alias("rule"), "id").unionByName(
        own.select(F.lit(REPOSTS_OWN).alias("rule"), F.col("edge_id").alias("id"))
    )


def summary(found: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """(rule, violations) for every rule; a rule nobody breaks has 0.

    ``found`` has one row per violation, or a ``rows`` column with how many.
    """
    amount = F.sum("rows") if "rows" in found.columns else F.count(F.lit(1))
    counted = found.groupBy("rule").agg(amount.cast("long").alias("violations"))
    every = found.sparkSession.createDataFrame([(rule,) for rule in rules], "rule string")
    return every.join(counted, "rule", "left").fillna(0, ["violations"])
