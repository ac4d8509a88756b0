"""From feed entries (which message, when, through whom) to cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.ratings import reposter_label
from agora.operators.engagement import MESSAGE_KEY, engagement, kind_of, viewer_id, with_engagement
from agora.operators.joins import INFLATED, fits_broadcast, many_to_one
from agora.operators.messages import cards, cards_of, few_with_people, messages, names
from agora.operators.pinning import Pinned, pin
from agora.operators.pruning import near
from agora.schema import COMMENT, POST, Tables


def repost_entries(reposts: DataFrame) -> DataFrame:
    """(user_id, kind, id, post_type, post_date) for each repost."""
    return reposts.select(
        "user_id",
        kind_of().alias("kind"),
        F.col("message_id").alias("id"),
        F.col("type").alias("post_type"),
        F.col("created_at").alias("post_date"),
    )


def own_entries(rows: DataFrame, kind: str) -> DataFrame:
    """The same columns for messages, which come from their authors."""
    return rows.select(
        F.col("author_id").alias("user_id"),
        F.lit(kind).alias("kind"),
        "id",
        F.lit(kind).alias("post_type"),
        F.col("created_at").alias("post_date"),
    )


def with_reposter(tables: Tables, rows: DataFrame, hot_from: DataFrame) -> DataFrame:
    """Name the ``reposter_id`` of any number of rows."""
    people = names(tables).select(
        F.col("id").alias("reposter_id"),
        F.col("username").alias("reposted_by_username"),
        F.col("display_name").alias("reposter_display_name"),
    )
    if fits_broadcast(people, INFLATED):
        return many_to_one(rows, people, ["reposter_id"], "left", hot_from=hot_from)
    # Rows without a reposter stay where they are.
    by_somebody, found = F.col("reposter_id").isNotNull(), people.schema
    named = many_to_one(rows.filter(by_somebody), people, ["reposter_id"], "left", hot_from=hot_from.filter(by_somebody))
    nobody = {c: F.lit(None).cast(found[c].dataType) for c in ("reposted_by_username", "reposter_display_name")}
    return named.unionByName(rows.filter(~by_somebody).withColumns(nobody))


def labelled(rows: DataFrame, viewer: Column) -> DataFrame:
    """Rows with ``reposted_by``, if they know of reposters at all."""
    if "reposter_id" not in rows.columns:
        return rows
    label = reposter_label(F.col("reposter_id"), viewer, F.col("reposter_display_name"))
    return rows.withColumn("reposted_by", label)


def entry_cards(tables: Tables, entries: Pinned, viewer: int | None) -> DataFrame:
    """Cards for the entries of one request, which are computed and counted.

    While they are few they are broadcast over the message and edge tables, so
    that nothing but the messages shown is aggregated or shuffled.  A request
    with more entries is answered like that of everybody.
    """
    me = F.lit(viewer_id(viewer))
    if not entries.small:
        return labelled(all_entry_cards(tables, entries.frame, viewer, hot_from=entries.frame), me)
    tables = near(tables, entries)
    rows = messages(tables).join(entries.hinted(), MESSAGE_KEY)
    rated = with_engagement(rows, engagement(tables, POST, COMMENT, viewer=viewer, only=entries))
    return labelled(few_with_people(tables, rated, viewer), me)


def all_entry_cards(
    tables: Tables, entries: DataFrame, viewer: int | None, hot_from: DataFrame, whole: tuple[str, ...] = ()
) -> DataFrame:
    """Any number of entries: the cards of their messages, and one join to them for each kind.

    ``whole`` names the kinds of which every message is an entry; of the others
    only the messages with an entry are looked at.  Reposters are named before the join,
    which makes the rows wide.
    """
    shown = {}
    for kind in (POST, COMMENT):
        if kind in whole:
            shown[kind] = cards(tables, kind, viewer)
            continue
        ids = pin(entries.filter(F.col("kind") == kind).select(*MESSAGE_KEY).distinct())
        if ids.rows:
            shown[kind] = cards_of(tables, kind, ids, viewer)
    if "reposter_id" in entries.columns:
        entries = with_reposter(tables, entries, hot_from=entries)
    on = ["id", "author_id"] if "author_id" in entries.columns else ["id"]
    sized_by = messages(tables)
    joined = [
        many_to_one(
            entries.filter(F.col("kind") == kind),
            found.drop("kind", "post_id", "parent_id"),
            on,
            hot_from=(hot_from if on == ["id"] else entries).filter(F.col("kind") == kind),
            sized_by=sized_by,
        )
        for kind, found in (shown or {POST: cards(tables, POST, viewer)}).items()
    ]
    return reduce(DataFrame.unionByName, joined)


def newest_per_message(entries: DataFrame, *who: str) -> DataFrame:
    """Of the entries about one message with one tag, the newest.

    Two reposts at the same instant are settled by the smaller reposter id.
    The first pass of the window runs before the shuffle and keeps one row per
    message and task, however often a message was reposted.
    """
    newest = Window.partitionBy(*who, "post_type", "id").orderBy(F.desc("post_date"), F.asc_nulls_last("reposter_id"))
    return entries.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") == 1).drop("__rank")
