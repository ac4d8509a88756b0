"""Applying batches of requests to the tables.

A batch is a frame of requests with a unique sequence number ``seq``; the
requests count as made one after the other in that order.  Every job gives the
table after the batch and an ``outcomes`` frame (seq, reason), where a null
reason means that the request went through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions.text import text_problems, user_problems
from agora.operators import ordered
from agora.operators.engagement import kind_of
from agora.operators.joins import any_hot, drop_found, keep_found, many_to_one
from agora.operators.messages import messages
from agora.operators.ordered import with_previous
from agora.operators.pinning import Pinned, pin
from agora.operators.settling import follow
from agora.plans.audit import (
    EMAIL_TAKEN,
    FOLLOW_REPEATED,
    FOLLOWS_SELF,
    LIKE_REPEATED,
    REPLY_ON_OTHER_POST,
    REPOST_REPEATED,
    REPOSTS_OWN,
    USERNAME_TAKEN,
)
from agora.schema import COMMENT, COMMENT_REPOST, POST, POST_REPOST, Tables

# Why a request is refused.
NO_EDGE = {
    "follows": "Unable to find follow reference.",
    "likes": "Unable to find like reference.",
    "reposts": "Unable to find repost reference.",
}
OTHERS = {POST: "Cannot update other's posts.", COMMENT: "Cannot update other's comments."}
NOT_FOUND = {POST: "Unable to find Post at given ID: ", COMMENT: "Unable to find Comment at given ID: "}
OTHER_ACCOUNT = "This account is inaccessible"
UNKNOWN_USER = "Unable to confirm user with token"
# Our name for a request that the database alone would refuse.
REPEATED = {"follows": FOLLOW_REPEATED, "likes": LIKE_REPEATED, "reposts": REPOST_REPEATED}

INSERT, DELETE = "insert", "delete"


@dataclass(frozen=True)
class Merged:
    table: DataFrame
    outcomes: DataFrame


def _reasons(*checks: tuple[Column, Column | str]) -> Column:
    """All that is wrong, joined into one text; null when nothing is."""
    named = [F.when(failed, F.lit(reason) if isinstance(reason, str) else reason) for failed, reason in checks]
    found = F.array_compact(F.array(*named))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def _exists(
    rows: DataFrame, keys: DataFrame, on: dict[str, str], name: str, hot_from: DataFrame | None = None
) -> DataFrame:
    """Add whether the key columns of ``rows`` name a row of ``keys``.

    ``hot_from``: the batch that ``rows`` come from, when they are joined already.
    """
    marked = keys.select(*[F.col(theirs).alias(ours) for ours, theirs in on.items()], F.lit(True).alias(name))
    return many_to_one(rows, marked, list(on), "left", hot_from=rows if hot_from is None else hot_from).fillna(False, [name])


def _judged_follows(tables: Tables, batch: DataFrame) -> DataFrame:
    known = _exists(batch, tables.users, {"follower_id": "id"}, "follower_known")
    known = _exists(known, tables.users, {"followee_id": "id"}, "followee_known", hot_from=batch)
    refused = _reasons(
        (~F.col("follower_known"), "Follower must exist"),
        (~F.col("followee_known"), "Followee must exist"),
        (F.col("follower_id") == F.col("followee_id"), FOLLOWS_SELF),
    )
    return known.withColumn("refused", refused).drop("follower_known", "followee_known")


def _judged_marks(tables: Tables, batch: DataFrame) -> DataFrame:
    """Judge likes or reposts of posts and comments."""
    authors = messages(tables).select("kind", F.col("id").alias("message_id"), "author_id")
    keyed = batch.withColumn("kind", kind_of())
    known = many_to_one(
        keyed, authors, ["kind", "message_id"], "left", hot_from=keyed, sized_by=messages(tables), few_from=keyed
    )
    known = _exists(known, tables.users, {"user_id": "id"}, "user_known", hot_from=batch)
    own_repost = F.col("type").isin(POST_REPOST, COMMENT_REPOST) & (F.col("author_id") == F.col("user_id"))
    refused = _reasons(
        (~F.col("user_known"), "User must exist"),
        (F.col("author_id").isNull(), F.concat("kind", F.lit(" must exist"))),
        (own_repost, REPOSTS_OWN),
    )
    return known.withColumn("refused", refused).drop("kind", "author_id", "user_known")


def apply_edges(tables: Tables, name: str, batch: DataFrame) -> Merged:
    """Insert and delete follows, likes or reposts.

    ``batch``: seq, action ('insert' or 'delete'), id (of the new row), the
    edge's key columns, created_at.  An insert must pass the rules of its table
    and a delete must find its edge, at the moment its turn comes: what came
    before on the same key in the batch counts.
    """
    table = getattr(tables, name)
    key = ["follower_id", "followee_id"] if name == "follows" else ["type", "user_id", "message_id"]
    judge = _judged_follows if name == "follows" else _judged_marks
    inserts = judge(tables, batch.filter(F.col("action") == INSERT))
    deletes = batch.filter(F.col("action") == DELETE).withColumn("refused", F.lit(None).cast("string"))
    judged = pin(inserts.unionByName(deletes)).frame

    # A refused insert leaves its key as it was; any other request decides it.
    deciding = judged.filter(F.col("refused").isNull())
    started = _exists(deciding, table, {k: k for k in key}, "stored")
    few = not any_hot(deciding, key, ordered.BLOCK)
    turns = with_previous(started, key, "seq", "action", "before", few=few)
    present = F.when(F.col("before").isNull(), F.col("stored")).otherwise(F.col("before") == INSERT)
    reason = F.when((F.col("action") == INSERT) & present, F.lit(REPEATED[name])).when(
        (F.col("action") == DELETE) & ~present, F.lit(NO_EDGE[name])
    )
    settled = pin(turns.select("seq", "action", "id", *key, "created_at", reason.alias("reason")))

    done = settled.frame.filter(F.col("reason").isNull())
    last = pin(
        done.groupBy(*key)
        .agg(F.max_by(F.struct("action", "id", "created_at"), "seq").alias("last"))
        .select(*key, "last.*")
    )
    added = last.frame.filter(F.col("action") == INSERT).select(*table.columns)
    refused = judged.filter(F.col("refused").isNotNull()).select("seq", F.col("refused").alias("reason"))
    return Merged(
        drop_found(table, Pinned(last.frame.select(*key), last.rows), key).unionByName(added),
        settled.frame.select("seq", "reason").unionByName(refused),
    )


def _text_reason() -> Column:
    problems = text_problems(F.col("text"))
    return F.when(F.size(problems) > 0, F.array_join(problems, "; "))


def create_posts(tables: Tables, batch: DataFrame) -> Merged:
    """``batch``: seq, id, text, author_id, created_at."""
    known = _exists(batch, tables.users, {"author_id": "id"}, "author_known")
    return _created(tables.posts, known, (~F.col("author_known"), "Author must exist"))


def create_comments(tables: Tables, batch: DataFrame) -> Merged:
    """``batch``: seq, id, text, post_id, author_id, parent_id, created_at; ids are unique.

    A parent is a stored comment, or one that was accepted earlier in the batch.
    """
    parents = tables.comments.select(F.col("id").alias("parent_id"), F.col("post_id").alias("parent_post_id"))
    known = _exists(batch, tables.users, {"author_id": "id"}, "author_known")
    known = _exists(known, tables.posts, {"post_id": "id"}, "post_known", hot_from=batch)
    known = pin(many_to_one(known, parents, ["parent_id"], "left", hot_from=batch)).frame
    created = batch.select(
        F.col("id").alias("parent_id"), F.col("seq").alias("parent_seq"), F.col("post_id").alias("new_post_id")
    )
    accepted = _accepted_replies(known, created)
    new_parents = created.join(accepted, F.col("parent_id") == F.col("accepted_id"), "left_semi")
    known = many_to_one(known, new_parents, ["parent_id"], "left", hot_from=batch).withColumn(
        "parent_post_id", F.coalesce("parent_post_id", F.when(F.col("parent_seq") < F.col("seq"), F.col("new_post_id")))
    )
    orphan = F.col("parent_id").isNotNull() & F.col("parent_post_id").isNull()
    return _created(
        tables.comments,
        known,
        (~F.col("author_known"), "Author must exist"),
        (~F.col("post_known"), "Post must exist"),
        (orphan, "Parent must exist"),
        (F.col("post_id") != F.col("parent_post_id"), REPLY_ON_OTHER_POST),
    )


def _accepted_replies(known: DataFrame, created: DataFrame) -> DataFrame:
    """(accepted_id) of the comments of a batch that go through.

    A comment whose parent is in the batch goes through when its own rules hold
    and its parent goes through.  Chains are followed by pointer jumping: each
    round looks twice as far up, so there are log2(length of a chain) rounds.
    """
    sound = F.col("author_known") & F.col("post_known") & _text_reason().isNull()
    fits = F.col("parent_id").isNull() | (F.col("parent_post_id") == F.col("post_id"))
    earlier = (F.col("parent_seq") < F.col("seq")) & (F.col("new_post_id") == F.col("post_id"))
    waits = F.col("parent_id").isNotNull() & F.col("parent_post_id").isNull() & F.coalesce(earlier, F.lit(False))
    rows = many_to_one(known, created, ["parent_id"], "left", hot_from=known).select(
        "id", (sound & (waits | F.coalesce(fits, F.lit(False)))).alias("good"), F.when(waits, F.col("parent_id")).alias("up")
    )
    rows = pin(rows.withColumn("up", F.when(F.col("good"), F.col("up"))))
    while rows.frame.filter(F.col("up").isNotNull()).limit(1).count():
        above = rows.frame.select(F.col("id").alias("up"), F.col("good").alias("good_above"), F.col("up").alias("next"))
        jumped = many_to_one(rows.frame, above, ["up"], "left", hot_from=rows.frame)
        good = F.col("good") & F.coalesce("good_above", F.lit(True))
        rows = pin(jumped.select("id", good.alias("good"), F.when(good, F.col("next")).alias("up")))
    return rows.frame.filter("good").select(F.col("id").alias("accepted_id"))


def _created(table: DataFrame, known: DataFrame, *checks: tuple[Column, str]) -> Merged:
    reason = _reasons((_text_reason().isNotNull(), _text_reason()), *checks)
    judged = pin(known.select("seq", *table.columns, reason.alias("reason"))).frame
    accepted = judged.filter(F.col("reason").isNull()).select(*table.columns)
    return Merged(table.unionByName(accepted), judged.select("seq", "reason"))


def edit_messages(tables: Tables, kind: str, batch: DataFrame) -> Merged:
    """Change texts.  ``batch``: seq, actor_id, id, text; only the author may."""
    table = tables.posts if kind == POST else tables.comments
    authors = table.select("id", "author_id")
    found = many_to_one(batch.select("seq", "actor_id", "id", "text"), authors, ["id"], "left", hot_from=batch)
    missing = F.concat(F.lit(NOT_FOUND[kind]), F.col("id").cast("string"))
    reason = (
        F.when(F.col("author_id").isNull(), missing)
        .when(F.col("author_id") != F.col("actor_id"), F.lit(OTHERS[kind]))
        .otherwise(_text_reason())
    )
    judged = pin(found.withColumn("reason", reason)).frame
    last = pin(
        judged.filter(F.col("reason").isNull()).groupBy("id").agg(F.max_by("text", "seq").alias("new_text"))
    )
    edited = (
        table.join(last.hinted(), "id", "left")
        .withColumn("text", F.coalesce("new_text", "text"))
        .select(*table.columns)
    )
    return Merged(edited, judged.select("seq", "reason"))


def create_users(tables: Tables, batch: DataFrame) -> Merged:
    """``batch``: seq, id, username, email, display_name, created_at.

    Usernames and emails are unique in whatever case, also within the batch,
    where the earlier accepted request keeps the name; see ``_contest``.
    """
    problems = user_problems(F.col("username"), F.col("email"), F.col("display_name"))
    stored = tables.users.select(F.lower("username").alias("name_key"), F.lower("email").alias("email_key"))
    keyed = (
        batch.withColumn("name_key", F.lower("username"))
        .withColumn("email_key", F.lower("email"))
        .withColumn("problems", problems)
    )
    judged = _exists(keyed, stored, {"name_key": "name_key"}, "name_taken")
    judged = pin(_exists(judged, stored, {"email_key": "email_key"}, "email_taken", hot_from=keyed)).frame
    sound = judged.filter((F.size("problems") == 0) & ~F.col("name_taken") & ~F.col("email_taken"))
    winners = pin(_contest(sound.select("seq", *NAME_KEYS)))

    # What an earlier winner holds is taken; a name has one winner at most.
    known = judged.join(winners.hinted("seq").withColumn("won", F.lit(True)), "seq", "left")
    for key, taken in zip(NAME_KEYS, ("name_taken", "email_taken"), strict=True):
        held = winners.frame.select(key, F.col("seq").alias("held_from"))
        known = many_to_one(known, held, [key], "left", hot_from=judged).withColumn(
            taken, F.col(taken) | F.coalesce(F.col("held_from") < F.col("seq"), F.lit(False))
        ).drop("held_from")
    reason = _reasons(
        (F.size("problems") > 0, F.array_join("problems", "; ")),
        (F.col("name_taken"), USERNAME_TAKEN),
        (F.col("email_taken"), EMAIL_TAKEN),
    )
    settled = pin(known.withColumn("reason", reason)).frame
    new = (
        settled.filter("won")
        .withColumn("email", F.lower("email"))
        .withColumn("confirmed_at", F.lit(None).cast("timestamp_ntz"))
        .select(*tables.users.columns)
    )
    return Merged(tables.users.unionByName(new), settled.select("seq", "reason"))


NAME_KEYS = ("name_key", "email_key")


def _contest(requests: DataFrame) -> DataFrame:
    """Of (seq, name_key, email_key) requests those that get both names, taken in order of ``seq``.

    A request gets its names unless an earlier one that went through has either.  In
    every round the requests that are the first open ones for both their names go
    through; one that has a single open request before it goes through if that one does
    not, so chains of these are settled together by pointer jumping, whatever their
    length; and those that share a name with an earlier winner are out.
    """
    undecided = pin(requests)
    winners: list[Pinned] = []
    while undecided.rows:
        rows = undecided.frame
        met = rows
        for key in NAME_KEYS:
            first = rows.groupBy(key).agg(F.min("seq").alias(f"first_{key}"))
            met = many_to_one(met, first, [key], hot_from=rows)
        met = pin(met).frame
        for key in NAME_KEYS:
            later = met.filter(F.col("seq") > F.col(f"first_{key}"))
            second = later.groupBy(key).agg(F.min("seq").alias(f"second_{key}"))
            met = many_to_one(met, second, [key], "left", hot_from=rows)
        before = []
        crowded = F.lit(False)
        for key in NAME_KEYS:
            is_first, is_second = (F.col("seq") == F.col(f"{place}_{key}") for place in ("first", "second"))
            before.append(F.when(~is_first, F.col(f"first_{key}")))
            crowded = crowded | ~(is_first | F.coalesce(is_second, F.lit(False)))
        one, two = before
        several = crowded | F.coalesce(one != two, F.lit(False))
        up = F.when(~several, F.coalesce(one, two))
        links = met.select(
            "seq", up.alias("up"), F.lit(False).alias("yes"), F.lit(True).alias("no"),
            F.when(~several & up.isNull(), F.lit(True)).alias("value"),
        )
        values, _ = follow(links)
        won = pin(rows.join(values.filter("value"), "seq").select("seq", *NAME_KEYS))
        winners.append(won)
        rest = drop_found(rows, Pinned(won.frame.select("seq"), won.rows), ["seq"])
        for key in NAME_KEYS:
            held = won.frame.select(key, F.col("seq").alias("held_from"))
            rest = many_to_one(rest, held, [key], "left", hot_from=rows).filter(
                F.col("held_from").isNull() | (F.col("held_from") > F.col("seq"))
            ).drop("held_from")
        undecided = pin(rest)
    every = [w.frame for w in winners] or [requests.limit(0)]
    return reduce(DataFrame.unionByName, every)


def edit_users(tables: Tables, batch: DataFrame) -> Merged:
    """Change display names and emails, each by its owner only.

    ``batch``: seq, actor_id, id, display_name, email; null leaves a field as it
    is.  An email must not belong to another user at the moment its request is made:
    what came before in the batch counts, emails it took and emails it set free.
    """
    asked = batch.withColumn("email_key", F.lower("email"))
    stored = tables.users.select(
        "id", F.col("username").alias("own_username"), F.col("email").alias("own_email"),
        F.col("display_name").alias("own_display_name"),
    )
    known = many_to_one(asked, stored, ["id"], "left", hot_from=asked)
    problems = user_problems(
        F.col("own_username"), F.coalesce("email", "own_email"), F.coalesce("display_name", "own_display_name")
    )
    foreign = F.col("own_username").isNull() | (F.col("actor_id") != F.col("id"))
    judged = pin(
        known.select(
            "seq", "id", "display_name", "email", "email_key", F.lower("own_email").alias("own_key"),
            foreign.alias("foreign"), problems.alias("problems"),
        )
    ).frame
    asks = judged.filter(~F.col("foreign") & F.col("email_key").isNotNull())
    free = _free_emails(tables, asks.select("seq", "id", "email_key", "own_key", (F.size("problems") == 0).alias("able")))
    reason = F.when(F.col("foreign"), F.lit(OTHER_ACCOUNT)).otherwise(
        _reasons((F.size("problems") > 0, F.array_join("problems", "; ")), (~F.col("free"), EMAIL_TAKEN))
    )
    settled = pin(judged.join(free, "seq", "left").withColumn("reason", reason)).frame

    done = settled.filter(F.col("reason").isNull())
    newest = pin(
        done.groupBy("id").agg(
            *[
                F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(f"new_{column}")
                for column in ("display_name", "email")
            ]
        )
    )
    users = (
        tables.users.join(newest.hinted(), "id", "left")
        .withColumn("display_name", F.coalesce("new_display_name", "display_name"))
        .withColumn("email", F.coalesce(F.lower("new_email"), "email"))
        .select(*tables.users.columns)
    )
    return Merged(users, settled.select("seq", "reason"))


# The place of the stored holder of an email in its timeline: before all requests.
_STORED = -(1 << 62)


def _free_emails(tables: Tables, asks: DataFrame) -> DataFrame:
    """(seq, free): whether the email a request asks for is free, or its user's own, when it is made.

    ``asks``: seq, id, email_key, own_key, able; those that are not able change nothing.

    A sweep over the timeline of every email finds, under a guess of which requests go
    through, the last event before each request: somebody took the email, or set it
    free by taking another.  If that event is not certain, the outcome hangs on its
    request: one outcome if that goes through, and one, from the event before, if it
    does not.  Such chains are followed by pointer jumping, which gives the next guess.
    A guess that repeats is the answer: the earliest request that a guess has wrong is
    right in the next one, and a chain of requests that wait for each other is right at
    once, so there are about as many sweeps as an email changes its mind, not requests.
    """
    asks = pin(asks)
    emails = pin(asks.frame.select("email_key").distinct())
    holders = keep_found(tables.users.select("id", F.lower("email").alias("email_key")), emails, ["email_key"])
    holders = pin(holders.groupBy("email_key").agg(F.min("id").alias("id"))).frame
    # The first guess: an email belongs to its holder, or to whoever asks first, unless that
    # user asks for another one as well.
    able = asks.frame.filter("able")
    claims = able.groupBy("email_key").agg(F.min_by("id", "seq").alias("first"))
    owners = claims.join(holders.withColumnRenamed("id", "holder"), "email_key", "left").select(
        "email_key", F.coalesce("holder", "first").alias("owner")
    )
    owners = pin(owners).frame
    wishes = able.groupBy(F.col("id").alias("owner")).agg(F.min("email_key").alias("one"), F.max("email_key").alias("other"))
    stays = (F.col("one") == F.col("email_key")) & (F.col("other") == F.col("email_key"))
    keepers = many_to_one(owners, wishes, ["owner"], "left").filter(F.coalesce(stays, F.lit(True))).select("email_key", "owner")
    guess = many_to_one(asks.frame, keepers, ["email_key"], "left", hot_from=asks.frame)
    guess = pin(guess.withColumn("free", F.coalesce(F.col("owner") == F.col("id"), F.lit(True))).drop("owner")).frame
    # An email is asked for, left by whom it was given to or who came with it, and held once.
    taken_or_left = [asks.frame.select("email_key")] * 2 + [asks.frame.select(F.col("own_key").alias("email_key"))]
    few = 2 * asks.rows <= ordered.BLOCK or not (
        any_hot(asks.frame, ["id"], ordered.BLOCK)
        or any_hot(reduce(DataFrame.unionByName, taken_or_left), ["email_key"], ordered.BLOCK)
    )
    while asks.rows:
        through = guess.filter(F.col("able") & F.col("free"))
        moved = ordered.with_last(through, ["id"], "seq", "email_key", "before", few)
        moved = moved.withColumn("left_key", F.coalesce("before", "own_key")).filter(F.col("left_key") != F.col("email_key"))
        left = moved.select("seq", "id", F.col("left_key").alias("email_key"))
        left = keep_found(left, emails, ["email_key"], hot_from=asks.frame)

        taken = F.struct(F.col("seq").alias("by"), F.col("id").alias("holder"))
        event = F.when(F.col("able") & F.col("free"), taken)
        timeline = (
            guess.select("email_key", "seq", "id", F.lit(True).alias("asks"), event.alias("event"))
            .unionByName(left.select(
                "email_key", "seq", "id", F.lit(False).alias("asks"),
                F.struct(F.col("seq").alias("by"), F.lit(None).cast("long").alias("holder")).alias("event"),
            ))
            .unionByName(holders.select(
                "email_key", F.lit(_STORED).alias("seq"), "id", F.lit(False).alias("asks"),
                F.struct(F.lit(None).cast("long").alias("by"), F.col("id").alias("holder")).alias("event"),
            ))
        )
        swept = ordered.with_last(timeline, ["email_key"], "seq", "event", "last", few)
        # Each event also knows the one before it, for the case that it does not happen.
        paired = swept.withColumn("event", F.when(F.col("event").isNotNull(), F.struct("event", "last"))).drop("last")
        paired = paired if few else pin(paired).frame
        seen = ordered.with_last(paired, ["email_key"], "seq", "event", "last", few).filter("asks")

        def open_to(holder: str) -> Column:
            return F.col(holder).isNull() | (F.col(holder) == F.col("id"))

        yes, no = open_to("last.event.holder"), open_to("last.last.holder")
        certain = F.col("last.event.by").isNull() | (yes == no)
        links = seen.select(
            "seq", F.when(~certain, F.col("last.event.by")).alias("up"), yes.alias("yes"), no.alias("no"),
            F.when(certain, yes).alias("value"),
        )
        values, _ = follow(links)
        new = pin(
            guess.withColumnRenamed("free", "was_free").join(values.withColumnRenamed("value", "free"), "seq")
        ).frame
        if not new.filter(F.col("able") & (F.col("free") != F.col("was_free"))).limit(1).count():
            return new.select("seq", "free")
        guess = new.drop("was_free")
    return guess.select("seq", "free")


def confirm_users(tables: Tables, batch: DataFrame) -> DataFrame:
    """Set confirmed_at of users that have none.  ``batch``: id, confirmed_at."""
    first = pin(batch.groupBy("id").agg(F.min("confirmed_at").alias("now")))
    return (
        tables.users.join(first.hinted(), "id", "left")
        .withColumn("confirmed_at", F.coalesce("confirmed_at", "now"))
        .select(*tables.users.columns)
    )


def confirmations(tables: Tables, batch: DataFrame) -> DataFrame:
    """(id, confirmed_at, reason) of each confirmation; one of a confirmed user changes nothing and goes through."""
    known = _exists(batch, tables.users, {"id": "id"}, "known")
    return known.select("id", "confirmed_at", _reasons((~F.col("known"), UNKNOWN_USER)).alias("reason"))
