"""The popular feed and the home feeds."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.ratings import POPULAR_COMMENT_REPOSTS, message_rating
from agora.operators.engagement import MESSAGE_KEY, engagement, kind_of
from agora.operators.entries import (
    all_entry_cards,
    entry_cards,
    labelled,
    newest_per_message,
    own_entries,
    repost_entries,
)
from agora.operators.joins import many_to_one
from agora.operators.messages import CARD, all_of_kind, cards, cards_of, few_of_kind, light, messages, messages_of, rated, steps
from agora.operators.nesting import ranked_in_ranges
from agora.operators.pinning import BROADCAST_ROWS, distilled, few_or_all, in_order, pin
from agora.operators.pruning import near, rows_at
from agora.schema import COMMENT, COMMENT_REPOST, POST, Tables
from agora.sources.stored import MONTH


def newest_day_first() -> list[Column]:
    """Feed order: newest day, then rating, then id; the last keys only fix ties."""
    return [
        F.to_date("post_date").desc(),
        F.desc("rating"),
        F.desc("id"),
        F.desc("post_date"),
        F.asc("post_type"),
    ]


POPULAR = (*CARD, "post_type", "post_date", "rating")


def _popular_comments(tables: Tables, viewer: int | None, since: date | None) -> DataFrame:
    """Cards of the comments with more than four reposts.

    They are found in the reposts alone, and all else is only looked at for
    them.
    """
    reposted = tables.reposts.filter(F.col("type") == COMMENT_REPOST).groupBy(F.col("message_id").alias("id"))
    popular = reposted.agg(F.count(F.lit(1)).alias("reposts")).filter(F.col("reposts") > POPULAR_COMMENT_REPOSTS)
    ids = pin(popular.select(F.lit(COMMENT).alias("kind"), "id"))
    return cards_of(tables, COMMENT, ids, viewer, _since(messages_of(tables, COMMENT), since))


def _since(rows: DataFrame, day: date | None) -> DataFrame:
    return rows if day is None else rows.filter(F.col("created_at") >= F.lit(day).cast("timestamp_ntz"))


def _newest_holding(posts: DataFrame, by: Column, limit: int) -> date | None:
    """The newest date such that it and the dates after hold ``limit`` posts; one row per date is counted."""
    counted = posts.groupBy(by.alias("at")).agg(F.count(F.lit(1)).alias("posts"))
    so_far = F.sum("posts").over(Window.orderBy(F.desc("at")))
    enough = counted.withColumn("so_far", so_far).filter(F.col("so_far") >= limit)
    return enough.agg(F.max("at")).first()[0]


def _months_since(tables: Tables, day: date | None) -> DataFrame:
    """Posts from a day on, read from the months that hold them if posts are stored by month."""
    layout = tables.layout
    if day is None or layout is None or layout.months is None:
        return _since(tables.posts, day)
    return _since(layout.months.filter(F.col(MONTH) >= F.trunc(F.lit(day), "month")).drop(MONTH), day)


def _first_day_needed(tables: Tables, limit: int) -> date | None:
    """The newest day such that it and the days after hold ``limit`` posts.

    Every post is in the feed and newer days come first, so the first ``limit``
    rows are all from then on.  Stored by month, posts are first counted by folder,
    and days in the newest months alone.
    """
    layout = tables.layout
    by_month = None if layout is None or layout.months is None else _newest_holding(layout.months, F.col(MONTH), limit)
    return _newest_holding(_months_since(tables, by_month), F.to_date("created_at"), limit)


def popular_feed(tables: Tables, viewer: int | None = None, limit: int | None = None) -> DataFrame:
    """All posts and the comments with more than four reposts, newest day first.

    With ``limit``, only days that can reach into the result are read, and names
    are looked up after the best rows are picked.
    """
    since = None if limit is None else _first_day_needed(tables, limit)
    comments = _popular_comments(tables, viewer, since)
    if limit is None:
        posts = cards(tables, POST, viewer)
    else:
        rows, few = few_or_all(messages_of(tables.with_(posts=_months_since(tables, since)), POST))
        close = tables if few is None else near(tables, few)
        order = [F.to_date("created_at").desc(), F.desc("rating"), F.desc("id")]
        best = rated(close, POST, rows, viewer, few).orderBy(*order).limit(limit)
        posts = (few_of_kind if limit <= BROADCAST_ROWS else all_of_kind)(tables, POST, best, viewer)
    tags = ((posts, POST), (comments, COMMENT_REPOST))
    shown = [
        rows.withColumn("post_type", F.lit(tag)).withColumn("post_date", F.col("created_at")).select(*POPULAR)
        for rows, tag in tags
    ]
    feed = shown[0].unionByName(shown[1]).orderBy(*newest_day_first())
    return feed if limit is None else feed.limit(limit)


VIEWER_MARKS = ("user_liked", "user_reposted", "user_followed")
HOME = (*CARD, "post_type", "post_date", "reposted_by", "reposted_by_username", "rating")


def home_feed(tables: Tables, viewer: int) -> DataFrame:
    """What the people a viewer follows, and the viewer, posted or reposted.

    Own rows are read in the same scans as the followees': the viewer is just
    one more source.  Each message appears once per tag, with its newest repost.
    """
    if viewer is None:
        raise ValueError("a home feed needs a viewer")
    followees = rows_at(tables, "follows", "follower_id", viewer).select(F.col("followee_id").alias("user_id"))
    me = rows_at(tables, "users", "id", viewer).select(F.col("id").alias("user_id"))
    sources = pin(followees.unionByName(me).distinct())

    posted = own_entries(tables.posts, POST).join(sources.hinted(), "user_id")
    reposted = repost_entries(tables.reposts).join(sources.hinted(), "user_id")
    entries = posted.withColumn("reposter_id", F.lit(None).cast("long")).unionByName(
        reposted.withColumn("reposter_id", F.col("user_id"))
    )
    kept = newest_per_message(entries).withColumn(
        "own_post", F.col("reposter_id").isNull() & (F.col("user_id") == viewer)
    )
    entries = pin(kept.drop("user_id"))
    shown = entry_cards(tables, entries, viewer)
    for mark in ("user_reposted", "user_followed"):
        shown = shown.withColumn(mark, F.col(mark) & ~F.col("own_post"))
    return in_order(shown.select(*HOME), entries.small, *newest_day_first())


def _rated_sources(tables: Tables) -> DataFrame:
    """Every post and every repost as a rated entry of the user it comes from."""
    posts = own_entries(tables.posts, POST).withColumn("is_repost", F.lit(False))
    reposts = repost_entries(tables.reposts).withColumn("is_repost", F.lit(True))
    ratings = engagement(tables, POST, COMMENT).select(*MESSAGE_KEY, message_rating().alias("rating"))
    return many_to_one(
        posts.unionByName(reposts), ratings, MESSAGE_KEY, "left", hot_from=reposts, sized_by=messages(tables)
    ).fillna(0, ["rating"])


def home_feed_all(tables: Tables, top: int | None = None, viewers: DataFrame | None = None) -> DataFrame:
    """Everybody's home feed, whole or the first ``top`` rows of each.

    With ``top`` the fan-out is bounded: a feed is ordered by keys that do not depend on who reads it, so nothing
    outside the best ``top`` rows of one source can reach the best ``top`` of a
    reader: each of those rows, or a newer repost of the same message, is also in
    the reader's feed and ranks above it.  Cutting every source to its best rows
    first bounds the fan-out to the followers and loses no row of the result.
    ``viewers`` has one column, ``viewer_id``; by default every user reads.
    """
    best = Window.partitionBy("user_id").orderBy(*newest_day_first())
    sources = _rated_sources(tables)
    if top is not None:
        ranks = sources.withColumn("__rank", F.row_number().over(best))
        sources = ranks.filter(F.col("__rank") <= top).drop("__rank")
    following = tables.follows.select(F.col("follower_id").alias("viewer_id"), F.col("followee_id").alias("user_id"))
    themselves = tables.users.select(F.col("id").alias("viewer_id"), F.col("id").alias("user_id"))
    readers = following.unionByName(themselves)
    if viewers is not None:
        readers = readers.join(viewers, "viewer_id", "left_semi")
    offered = many_to_one(readers, sources, ["user_id"], hot_from=tables.follows.select(
        F.col("followee_id").alias("user_id"))).withColumn("reposter_id", F.when(F.col("is_repost"), F.col("user_id")))

    def ranked() -> DataFrame:
        """Narrow, ranked and final rows: from here on only looks things up."""
        kept = newest_per_message(offered, "viewer_id")
        if top is None:
            # A viewer may read a third of all rows, so a feed is ranked by many tasks.
            kept = ranked_in_ranges(steps(tables)(lambda: kept), "viewer_id", newest_day_first(), "position")
        else:
            place = Window.partitionBy("viewer_id").orderBy(*newest_day_first())
            kept = kept.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= top)
        return kept.select("viewer_id", "position", *MESSAGE_KEY, "post_type", "post_date", "reposter_id")

    return _decorated(tables, ranked)


def _decorated(tables: Tables, ranked: Callable[[], DataFrame]) -> DataFrame:
    """Cards, marks and labels for ranked (viewer_id, kind, id, ...) rows.

    When no side is small, marks are found before texts and names make the rows wide.
    """
    spark = tables.posts.sparkSession

    def marks(edges: DataFrame, like: bool) -> DataFrame:
        return edges.select(
            F.col("user_id").alias("viewer_id"),
            kind_of().alias("kind"),
            F.col("message_id").alias("id"),
            F.lit(like).alias("user_liked"),
            F.lit(not like).alias("user_reposted"),
        )

    key = ["viewer_id", *MESSAGE_KEY]
    viewer_marks = (
        marks(tables.likes, True)
        .unionByName(marks(tables.reposts, False))
        .groupBy(*key)
        .agg(F.bool_or("user_liked").alias("user_liked"), F.bool_or("user_reposted").alias("user_reposted"))
    )
    followed = tables.follows.select(
        F.col("follower_id").alias("viewer_id"),
        F.col("followee_id").alias("author_id"),
        F.lit(True).alias("user_followed"),
    ).distinct()

    def marked(rows: DataFrame) -> DataFrame:
        found = rows.join(viewer_marks, key, "left").join(followed, ["viewer_id", "author_id"], "left")
        return found.fillna(False, [*VIEWER_MARKS])

    def with_marks() -> DataFrame:
        feed = distilled(spark, ranked).frame
        authors = messages(tables).groupBy(*MESSAGE_KEY).agg(F.collect_set("author_id").alias("author_ids"))
        written = many_to_one(feed, authors, MESSAGE_KEY, hot_from=feed, sized_by=messages(tables))
        rows = written.withColumn("author_id", F.explode("author_ids")).drop("author_ids")
        return marked(rows).withColumnsRenamed({mark: f"viewer_{mark}" for mark in VIEWER_MARKS})

    if light(tables, POST, COMMENT):
        feed = distilled(spark, ranked).frame
        shown = marked(all_entry_cards(tables, feed, None, hot_from=feed).drop(*VIEWER_MARKS))
    else:
        feed = distilled(spark, with_marks).frame
        shown = all_entry_cards(tables, feed, None, hot_from=feed).drop(*VIEWER_MARKS)
        shown = shown.withColumnsRenamed({f"viewer_{mark}": mark for mark in VIEWER_MARKS})
    return labelled(shown, F.col("viewer_id")).select("viewer_id", "position", *HOME)
