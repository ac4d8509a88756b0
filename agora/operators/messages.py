"""Posts and comments as cards: a message with its counts, marks and people."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.engagement import MESSAGE_KEY, engagement, viewer_id, with_engagement
from agora.operators.joins import fits_broadcast, keep_found, many_to_one
from agora.operators.pinning import Pinned, distilled
from agora.operators.pruning import near, rows_at
from agora.schema import COMMENT, POST, Tables

# The columns of a card, shared by every feed, search and thread.
CARD = (
    "id",
    "text",
    "created_at",
    "like_count",
    "repost_count",
    "comment_count",
    "user_liked",
    "user_reposted",
    "user_followed",
    "replying_to",
    "author_id",
    "author_username",
    "author_display_name",
)

def posts_as_messages(posts: DataFrame) -> DataFrame:
    """Posts in the shape of comments; a post is its own thread."""
    return posts.selectExpr(
        f"'{POST}' AS kind", "id", "text", "id AS post_id", "author_id", "CAST(NULL AS BIGINT) AS parent_id", "created_at"
    )


def comments_as_messages(comments: DataFrame) -> DataFrame:
    return comments.selectExpr(f"'{COMMENT}' AS kind", "id", "text", "post_id", "author_id", "parent_id", "created_at")


def messages(tables: Tables) -> DataFrame:
    """Posts and comments as one kind of row."""
    return posts_as_messages(tables.posts).unionByName(comments_as_messages(tables.comments))


def messages_of(tables: Tables, kind: str) -> DataFrame:
    return posts_as_messages(tables.posts) if kind == POST else comments_as_messages(tables.comments)


def names(tables: Tables) -> DataFrame:
    return tables.users.select("id", "username", "display_name")


def with_followed(tables: Tables, rows: DataFrame, viewer: int | None) -> DataFrame:
    """Whether the viewer follows the author of each row."""
    me = viewer_id(viewer)
    if me == 0:
        return rows.selectExpr("*", "false AS user_followed")
    mine = rows_at(tables, "follows", "follower_id", me)
    followed = mine.selectExpr("followee_id AS author_id", "true AS followed").distinct()
    return rows.join(followed, "author_id", "left").selectExpr(
        *rows.columns, "coalesce(followed, false) AS user_followed"
    )


# Whom a comment answers: the parent's author, then the post's, each once.
REPLYING_TO = f"""CASE WHEN kind = '{COMMENT}'
  THEN array_distinct(array_compact(array(parent_author_username, post_author_username))) END AS replying_to"""
NOBODY = "CAST(NULL AS ARRAY<STRING>) AS replying_to"
AUTHOR = {"author_username": "username", "author_display_name": "display_name"}


def few_with_people(tables: Tables, rows: DataFrame, viewer: int | None) -> DataFrame:
    """A *bounded* frame of messages with everyone named on them.

    Each row asks for three authors: its own, its post's and its parent's.  The
    asking rows, three or four per message, are broadcast, once over posts and
    comments to find the authors, once over users to find their names, and one
    aggregation brings the answers back together.  Nothing big is shuffled.  A
    ``reposter_id`` column is named as well.  Equal rows stay apart by a number.
    """
    columns = rows.columns
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    asked = rows.selectExpr(
        "*",
        f"""explode(array(
          named_struct('role', 'author', 'kind', kind, 'id', id),
          named_struct('role', 'post_author', 'kind', '{POST}', 'id', post_id),
          named_struct('role', 'parent_author', 'kind', '{COMMENT}', 'id', parent_id))) AS ask""",
    ).selectExpr(*rows.columns, "ask.role AS role", "ask.kind AS asked_kind", "ask.id AS asked_id")
    authors = messages(tables).selectExpr("kind AS asked_kind", "id AS asked_id", "author_id AS person")
    found = authors.join(F.broadcast(asked), ["asked_kind", "asked_id"])
    people = found.select(*rows.columns, "role", "person")
    if "reposter_id" in rows.columns:
        people = people.selectExpr(
            *rows.columns,
            """explode(CASE WHEN role = 'author' AND reposter_id IS NOT NULL
              THEN array(named_struct('role', role, 'id', person), named_struct('role', 'reposter', 'id', reposter_id))
              ELSE array(named_struct('role', role, 'id', person)) END) AS ask""",
        ).selectExpr(*rows.columns, "ask.role AS role", "ask.id AS person")
    every = names(tables).selectExpr("id AS person", "username", "display_name")
    named = every.join(F.broadcast(people), "person")

    def answer(role: str, column: str, alias: str):
        return F.expr(f"max(CASE WHEN role = '{role}' THEN {column} END)").alias(alias)

    answers = [
        answer("author", "username", "author_username"),
        answer("author", "display_name", "author_display_name"),
        answer("post_author", "username", "post_author_username"),
        answer("parent_author", "username", "parent_author_username"),
    ]
    kept = [*columns, "author_username", "author_display_name", REPLYING_TO]
    if "reposter_id" in rows.columns:
        answers.append(answer("reposter", "username", "reposted_by_username"))
        answers.append(answer("reposter", "display_name", "reposter_display_name"))
        kept += ["reposted_by_username", "reposter_display_name"]
    gathered = named.groupBy(*rows.columns).agg(*answers)
    return with_followed(
        tables,
        gathered.filter("author_username IS NOT NULL AND post_author_username IS NOT NULL").selectExpr(*kept),
        viewer,
    )


def few_posts_with_people(tables: Tables, rows: DataFrame, viewer: int | None) -> DataFrame:
    """``few_with_people`` when there are only posts, which answer nobody."""
    return with_followed(tables, few_with_authors(tables, rows).selectExpr("*", NOBODY), viewer)


def few_with_authors(tables: Tables, rows: DataFrame) -> DataFrame:
    """A *bounded* frame with its authors' names: users are read past it once."""
    authors = names(tables).selectExpr(
        "id AS author_id", "username AS author_username", "display_name AS author_display_name"
    )
    return authors.join(F.broadcast(rows), "author_id").select(
        *rows.columns, "author_username", "author_display_name"
    )


def _authors(tables: Tables, viewer: int | None) -> DataFrame:
    """Every user as an author: names, and whether the viewer follows them."""
    authors = names(tables).select(
        F.col("id").alias("author_id"),
        F.col("username").alias("author_username"),
        F.col("display_name").alias("author_display_name"),
    )
    return with_followed(tables, authors, viewer)


def _username_by_author(tables: Tables, alias: str) -> DataFrame:
    return tables.users.select(F.col("id").alias("author_id"), F.col("username").alias(alias))


def posts_with_people(tables: Tables, rows: DataFrame, viewer: int | None) -> DataFrame:
    """Any number of posts with their authors; posts answer nobody."""
    named = many_to_one(rows, _authors(tables, viewer), ["author_id"], hot_from=tables.posts, sized_by=tables.users)
    return named.selectExpr("*", NOBODY)


def comments_with_people(tables: Tables, rows: DataFrame, viewer: int | None) -> DataFrame:
    """Any number of comments with their authors and the people they answer.

    The usernames behind post and parent are found on narrow (id, author) rows,
    so that the texts move only for the joins of the comments themselves.
    """
    comments = tables.comments
    posts = tables.posts.select(F.col("id").alias("post_id"), "author_id")
    post_author = many_to_one(posts, _username_by_author(tables, "post_author_username"), ["author_id"])
    parents = comments.select(F.col("id").alias("parent_id"), "author_id")
    parent_author = many_to_one(parents, _username_by_author(tables, "parent_author_username"), ["author_id"])
    named = many_to_one(rows, _authors(tables, viewer), ["author_id"], hot_from=comments, sized_by=tables.users)
    named = many_to_one(named, post_author.drop("author_id"), ["post_id"], hot_from=comments, sized_by=posts)
    named = many_to_one(
        named, parent_author.drop("author_id"), ["parent_id"], "left", hot_from=comments, sized_by=parents
    )
    return named.selectExpr("*", REPLYING_TO).drop("parent_author_username", "post_author_username")


def _named_in_steps(tables: Tables, kind: str, rows: DataFrame, viewer: int | None) -> DataFrame:
    """``all_of_kind`` for rows of ids, one join after the other, so that no two share the disk.

    Names come last, since every join moves what was found before.
    """
    spark = rows.sparkSession
    if kind == POST:
        return distilled(spark, lambda: posts_with_people(tables, rows, viewer)).frame
    comments = tables.comments

    def to_posts() -> DataFrame:
        posts = tables.posts.select(F.col("id").alias("post_id"), "author_id")
        post_author = many_to_one(posts, _username_by_author(tables, "post_author_username"), ["author_id"])
        return many_to_one(rows, post_author.drop("author_id"), ["post_id"], hot_from=comments, sized_by=posts)

    def to_parents() -> DataFrame:
        asked = distilled(spark, to_posts).frame
        parents = comments.select(F.col("id").alias("parent_id"), "author_id")
        parent_author = distilled(
            spark, lambda: many_to_one(parents, _username_by_author(tables, "parent_author_username"), ["author_id"])
        ).frame
        return many_to_one(
            asked, parent_author.drop("author_id"), ["parent_id"], "left", hot_from=comments, sized_by=parents
        )

    def to_authors() -> DataFrame:
        asked = distilled(spark, to_parents).frame
        named = many_to_one(asked, _authors(tables, viewer), ["author_id"], hot_from=comments, sized_by=tables.users)
        return named.selectExpr("*", REPLYING_TO).drop("parent_author_username", "post_author_username")

    return distilled(spark, to_authors).frame


def light(tables: Tables, *kinds: str) -> bool:
    """Whether all that messages of these kinds are joined to may be broadcast."""
    sides = [tables.users, tables.posts, tables.comments] if COMMENT in kinds else [tables.users]
    return all(fits_broadcast(side) for side in sides)


def steps(tables: Tables) -> Callable[..., DataFrame]:
    """How a plan over comments takes a step: pinned once it is too big to broadcast, else as it is.

    A pinned step may be sorted within its tasks, so that it packs and shuffles in less.
    """
    if light(tables, COMMENT):
        return lambda make, *order: make()
    spark = tables.comments.sparkSession
    return lambda make, *order: distilled(spark, lambda: make().sortWithinPartitions(*order) if order else make()).frame


def rated(
    tables: Tables, kind: str, rows: DataFrame, viewer: int | None = None, only: Pinned | None = None
) -> DataFrame:
    """Message rows of one kind with counts, the viewer's marks and the rating."""
    return with_engagement(rows, engagement(tables, kind, viewer=viewer, only=only), one_kind=True)


def few_of_kind(tables: Tables, kind: str, rows: DataFrame, viewer: int | None) -> DataFrame:
    """``few_with_people`` for one kind; posts need no look at other messages."""
    return (few_posts_with_people if kind == POST else few_with_people)(tables, rows, viewer)


def all_of_kind(tables: Tables, kind: str, rows: DataFrame, viewer: int | None) -> DataFrame:
    """Any number of rows of one kind with people."""
    return (posts_with_people if kind == POST else comments_with_people)(tables, rows, viewer)


def cards(tables: Tables, kind: str, viewer: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Cards of all messages of one kind, or of ``rows``, which hold no counts yet.

    When a side is too big to broadcast, people are gathered on rows of ids alone, in steps,
    and counts and texts move once, for the last joins, after which the cards lie by id.
    """
    rows = messages_of(tables, kind) if rows is None else rows
    if light(tables, kind):
        known = rated(tables, kind, all_of_kind(tables, kind, rows, viewer), viewer)
    else:
        named = _named_in_steps(tables, kind, rows.drop("text", "created_at"), viewer)
        known = rated(tables, kind, named, viewer).join(rows.select("id", "text", "created_at"), "id")
    return known.select("kind", *CARD, "rating", "post_id", "parent_id")


def cards_of(
    tables: Tables, kind: str, ids: Pinned, viewer: int | None = None, rows: DataFrame | None = None
) -> DataFrame:
    """Cards of the messages of one kind that the computed (kind, id) keys name."""
    rows = keep_found(messages_of(tables, kind) if rows is None else rows, ids, MESSAGE_KEY)
    if not ids.small:
        return cards(tables, kind, viewer, rows)
    tables = near(tables, ids)
    return few_of_kind(tables, kind, rated(tables, kind, rows, viewer, ids), viewer).select(
        "kind", *CARD, "rating", "post_id", "parent_id"
    )


def message_counts(tables: Tables) -> DataFrame:
    """Counts and rating of every message."""
    rows = messages(tables).select(*MESSAGE_KEY)
    counted = with_engagement(rows, engagement(tables, POST, COMMENT))
    return counted.select(*MESSAGE_KEY, "like_count", "repost_count", "comment_count", "rating")


def author_record() -> Column:
    return F.struct(
        F.col("author_id").alias("id"),
        F.col("author_username").alias("username"),
        F.col("author_display_name").alias("display_name"),
    )


def as_records(flat: DataFrame) -> DataFrame:
    """Flat cards with the author nested into one record."""
    kept = [c for c in flat.columns if not c.startswith("author_")]
    return flat.select(*kept, author_record().alias("author"))
