"""Every contract query as a function (spark, sf_dir) -> DataFrame with flat columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators.messages import message_counts
from agora.plans import audit, cascade, details, feeds, lists, merge, people, profiles, search, threads, writeback
from agora.schema import COMMENT, POST, Tables
from agora.session import shared_dir
from agora.sources import driverbatches as batches
from agora.sources import driverdata, nested

VIEWER = 1
PROFILE = 2
POST_ID = 21
COMMENT_ID = 20
USERNAME = "CUSTOMER_000000001"
TERMS = ["urgent", "3-medium", "order 1_ ", "NOT_spec", "100%", r"order\ 2"]

Query = Callable[[SparkSession, str], DataFrame]


def _flat(rows: DataFrame) -> DataFrame:
    """Lists of names as comma-separated text, for comparing with SQL."""
    if "replying_to" in rows.columns:
        rows = rows.withColumn("replying_to", F.array_join("replying_to", ","))
    if "problems" in rows.columns:
        rows = rows.withColumn("problems", F.array_join("problems", "; "))
    return rows


def _on_tables(job: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: _flat(job(driverdata.load(spark, sf_dir)))


def _on_raw(job: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: _flat(job(driverdata.raw_tables(spark, sf_dir)))


def _with_batch(job: Callable[[Tables, DataFrame], DataFrame], batch: Query) -> Query:
    return lambda spark, sf_dir: _flat(job(driverdata.load(spark, sf_dir), batch(spark, sf_dir)))


def _search_top(tables: Tables) -> DataFrame:
    found = search.search_top(tables, "1", VIEWER)
    users = found["users"].select(
        F.lit("User").alias("kind"), "id", F.col("username").alias("label"), F.col("user_rating").alias("rating")
    )
    messages = [
        found[name].select(F.lit(kind).alias("kind"), "id", F.col("text").alias("label"), "rating")
        for name, kind in (("posts", POST), ("comments", COMMENT))
    ]
    return reduce(DataFrame.unionByName, messages, users)


def _unconfirmed_missing(tables: Tables) -> DataFrame:
    """References to users that are not confirmed, as if those did not exist."""
    confirmed = tables.with_(users=lists.confirmed_users(tables))
    return audit.summary(audit.missing_references(confirmed), audit.REFERENCE_RULES)


def _unique(tables: Tables) -> DataFrame:
    found = audit.repeated_keys(tables)
    return audit.summary(found, audit.UNIQUE_RULES)


def _delete_posts(tables: Tables, requests: DataFrame) -> DataFrame:
    granted = cascade.delete_requests(tables, POST, requests).filter(F.col("reason").isNull())
    return cascade.remaining_ids(cascade.cascade_delete(tables, posts=granted))


def _delete_comments(tables: Tables) -> DataFrame:
    requests = batches.comment_deletions(tables.comments)
    granted = cascade.delete_requests(tables, COMMENT, requests).filter(F.col("reason").isNull())
    return cascade.remaining_ids(cascade.cascade_delete(tables, comments=granted))


def _delete_users(tables: Tables) -> DataFrame:
    return cascade.remaining_ids(cascade.cascade_delete(tables, users=lists.unconfirmed_users(tables)))


def _edges(name: str, part: str) -> Callable[[Tables, DataFrame], DataFrame]:
    return lambda tables, batch: getattr(merge.apply_edges(tables, name, batch), part)


def _edge_job(name: str) -> writeback.Job:
    return lambda tables, batch: merge.apply_edges(tables, name, batch)


def _in_place(name: str, batch: Query, job: writeback.Job) -> Query:
    """The stored table after a batch that replaced only the buckets it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, path = driverdata.own_copy(spark, sf_dir, name)
        return getattr(writeback.apply_in_place(tables, name, path, batch(spark, sf_dir), job).tables, name)

    return run


def _misplaced(tables: Tables) -> DataFrame:
    return audit.summary(audit.misplaced_replies(tables), (audit.REPLY_ON_OTHER_POST,))


def _misplaced_by_author(tables: Tables) -> DataFrame:
    """The reply rule with each comment's author id taken as its parent's id."""
    crossed = tables.comments.withColumn("parent_id", F.col("author_id"))
    return audit.misplaced_replies(tables.with_(comments=crossed))


def _self_edges(tables: Tables) -> DataFrame:
    return audit.summary(audit.self_edges(tables), (audit.FOLLOWS_SELF, audit.REPOSTS_OWN))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(audit.audit_messages(driverdata.source(spark, sf_dir, "documents"), "doc_id"))


def _document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.problem_counts(audit.audit_messages(driverdata.source(spark, sf_dir, "documents"), "doc_id"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(audit.audit_messages(driverdata.source(spark, sf_dir, "conversations"), "conv_id", "turn"))


def _message_problems(tables: Tables) -> DataFrame:
    """Rows per problem over all posts and comments; a problem nobody has counts 0."""
    rows = tables.posts.select("id", "text").unionByName(tables.comments.select("id", "text"))
    found = audit.problem_counts(audit.audit_messages(rows)).withColumnRenamed("problem", "rule")
    return audit.summary(found, audit.TEXT_RULES)


def _user_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user rules on all sign-up requests."""
    return _flat(audit.audit_users(batches.new_users(spark, sf_dir)))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.normalise_users(batches.new_users(spark, sf_dir)).select("id", "email")


def _stored_records(spark: SparkSession, records: DataFrame, key: str) -> DataFrame:
    """The records as they come back from JSON lines."""
    path = f"{shared_dir(spark).rstrip('/')}/agora-records-{uuid.uuid4().hex}"
    nested.write_records(records, key, path, driverdata.BUCKETS, dealt=True)
    return nested.read_records(spark, path, records.schema)


QUERIES: dict[str, Query] = {
    "message_counts": _on_tables(message_counts),
    "user_counts": _on_tables(people.user_counts),
    "search_posts": _on_tables(lambda t: search.search_posts(t, "urgent", VIEWER)),
    "search_posts_anonymous": _on_tables(lambda t: search.search_posts(t, "urgent")),
    "search_posts_limit": _on_tables(lambda t: search.search_posts(t, "urgent", VIEWER, 2)),
    "search_posts_wildcards": _on_tables(lambda t: search.search_terms(t, TERMS, VIEWER)),
    "search_comments": _on_tables(lambda t: search.search_comments(t, "RETURNED r", VIEWER)),
    "search_users": _on_tables(lambda t: search.search_users(t, "0001", VIEWER)),
    "search_users_self": _on_tables(lambda t: search.search_users(t, "0001", PROFILE)),
    "search_top": _on_tables(_search_top),
    "search_quick": _on_tables(lambda t: search.search_quick(t, "0001", VIEWER)),
    "search_terms_batch": _on_tables(lambda t: search.search_terms(t, TERMS, VIEWER, 3)),
    "search_comment_terms_batch": _on_tables(
        lambda t: search.search_terms(t, ["returned r", "line 2"], VIEWER, 3, COMMENT)
    ),
    "search_many_terms": lambda spark, sf_dir: _flat(search.search_many_terms(
        driverdata.load(spark, sf_dir), driverdata.gram_index(spark, sf_dir, POST), batches.search_terms(spark, sf_dir), VIEWER, 3
    )),
    "search_users_terms": lambda spark, sf_dir: search.search_users_terms(
        driverdata.load(spark, sf_dir), driverdata.gram_index(spark, sf_dir, driverdata.USER),
        batches.people_terms(spark, sf_dir), VIEWER, 3,
    ),
    "popular_feed": _on_tables(lambda t: feeds.popular_feed(t, VIEWER)),
    "popular_feed_anonymous": _on_tables(feeds.popular_feed),
    "popular_feed_limit": _on_tables(lambda t: feeds.popular_feed(t, VIEWER, 50)),
    "home_feed": _on_tables(lambda t: feeds.home_feed(t, VIEWER)),
    "home_feed_all": _on_tables(lambda t: feeds.home_feed_all(t, 20)),
    "home_feed_all_rows": _on_tables(feeds.home_feed_all),
    "profile_posts": _on_tables(lambda t: profiles.profile_posts(t, PROFILE, VIEWER)),
    "profile_posts_self": _on_tables(lambda t: profiles.profile_posts(t, PROFILE, PROFILE)),
    "profile_posts_all": _on_tables(lambda t: profiles.profile_posts_all(t, VIEWER)),
    "profile_comments": _on_tables(lambda t: profiles.profile_comments(t, PROFILE, VIEWER)),
    "profile_comments_all": _on_tables(lambda t: profiles.profile_comments_all(t, VIEWER)),
    "liked_messages": _on_tables(lambda t: profiles.liked_messages(t, PROFILE, VIEWER)),
    "liked_messages_all": _on_tables(lambda t: profiles.liked_messages_all(t, VIEWER)),
    "post_thread": _on_tables(lambda t: threads.post_thread(t, POST_ID, VIEWER)),
    "post_threads_all": _on_tables(lambda t: threads.post_threads_all(t, VIEWER)),
    "nested_threads": _on_tables(
        lambda t: threads.nested_threads(threads.post_threads_all(t, VIEWER)).select(
            "thread_id", "part", "parts", F.posexplode("comments").alias("position", "comment")
        ).select("thread_id", "part", "parts", "position", "comment.id",
                 F.col("comment.author.id").alias("author_id"), F.col("comment.author.username").alias("author_username"))
    ),
    "comment_thread": _on_tables(lambda t: threads.comment_thread(t, COMMENT_ID, VIEWER)),
    "comment_threads_all": _on_tables(lambda t: threads.comment_threads_all(t, VIEWER)),
    "post_list": _on_tables(lists.post_list),
    "author_posts": _on_tables(lambda t: lists.author_posts(t, PROFILE)),
    "post_detail": _on_tables(lambda t: threads.post_detail(t, POST_ID, VIEWER)),
    "comment_detail": _on_tables(lambda t: threads.comment_detail(t, COMMENT_ID, VIEWER)),
    "post_detail_nested": lambda spark, sf_dir: details.flat_post_details(
        _stored_records(spark, details.post_details_all(driverdata.load(spark, sf_dir), VIEWER), "post_id")
    ),
    "comment_detail_nested": lambda spark, sf_dir: details.flat_comment_details(
        _stored_records(spark, details.comment_details_all(driverdata.load(spark, sf_dir), VIEWER), "comment_id")
    ),
    "user_comments": _on_tables(lambda t: threads.flat_user_comments(threads.user_comments(t, PROFILE))),
    "user_comments_all": _on_tables(lambda t: threads.flat_user_comments(threads.user_comments_all(t))),
    "user_stats": _on_tables(lambda t: people.user_stats(t, USERNAME, VIEWER)),
    "user_stats_all": _on_tables(lambda t: people.user_stats_all(t, VIEWER)),
    "followed_users": _on_tables(lambda t: people.followed_users(t, USERNAME, VIEWER)),
    "followers": _on_tables(lambda t: people.followers(t, USERNAME, VIEWER)),
    "followed_users_all": _on_tables(lambda t: people.followed_users_all(t, VIEWER)),
    "followers_all": _on_tables(lambda t: people.followers_all(t, VIEWER)),
    "liked_posts": _on_tables(lambda t: profiles.liked_posts(t, PROFILE)),
    "liked_comments": _on_tables(lambda t: profiles.liked_comments(t, PROFILE)),
    "reposted_posts": _on_tables(lambda t: profiles.reposted_posts(t, PROFILE)),
    "reposted_comments": _on_tables(lambda t: profiles.reposted_comments(t, PROFILE)),
    "liked_posts_all": _on_tables(profiles.liked_posts_all),
    "liked_comments_all": _on_tables(profiles.liked_comments_all),
    "reposted_posts_all": _on_tables(profiles.reposted_posts_all),
    "reposted_comments_all": _on_tables(profiles.reposted_comments_all),
    "top_level_comments": _on_tables(lists.top_level_comments),
    "reply_comments": _on_tables(lists.reply_comments),
    "confirmed_users": _on_tables(lists.confirmed_users),
    "unconfirmed_users": _on_tables(lists.unconfirmed_users),
    "audit_messages": _on_tables(_message_problems),
    "audit_documents": _documents,
    "audit_document_problems": _document_problems,
    "audit_conversations": _conversations,
    "audit_users": _user_problems,
    "normalise_users": _normalised,
    "audit_unique": _on_raw(_unique),
    "audit_references": _on_raw(_unconfirmed_missing),
    "audit_replies": _on_raw(_misplaced),
    "audit_replies_crossed": _on_raw(_misplaced_by_author),
    "audit_self_edges": _on_raw(_self_edges),
    "apply_follows": _with_batch(_edges("follows", "table"), batches.follow_requests),
    "apply_follows_outcomes": _with_batch(_edges("follows", "outcomes"), batches.follow_requests),
    "apply_likes": _with_batch(_edges("likes", "table"), batches.like_requests),
    "apply_likes_outcomes": _with_batch(_edges("likes", "outcomes"), batches.like_requests),
    "apply_reposts": _with_batch(_edges("reposts", "table"), batches.repost_requests),
    "apply_reposts_outcomes": _with_batch(_edges("reposts", "outcomes"), batches.repost_requests),
    "create_posts": _with_batch(lambda t, b: merge.create_posts(t, b).table, batches.new_posts),
    "create_posts_outcomes": _with_batch(lambda t, b: merge.create_posts(t, b).outcomes, batches.new_posts),
    "create_comments": _with_batch(lambda t, b: merge.create_comments(t, b).table, batches.new_comments),
    "create_comments_outcomes": _with_batch(lambda t, b: merge.create_comments(t, b).outcomes, batches.new_comments),
    "edit_posts": _with_batch(lambda t, b: merge.edit_messages(t, POST, b).table, batches.post_edits),
    "edit_posts_outcomes": _with_batch(lambda t, b: merge.edit_messages(t, POST, b).outcomes, batches.post_edits),
    "edit_comments": _with_batch(lambda t, b: merge.edit_messages(t, COMMENT, b).table, batches.comment_edits),
    "edit_comments_outcomes": _with_batch(
        lambda t, b: merge.edit_messages(t, COMMENT, b).outcomes, batches.comment_edits
    ),
    "follows_in_place": _in_place("follows", batches.follow_requests, _edge_job("follows")),
    "likes_in_place": _in_place("likes", batches.like_requests, _edge_job("likes")),
    "reposts_in_place": _in_place("reposts", batches.repost_requests, _edge_job("reposts")),
    "new_posts_in_place": _in_place("posts", batches.new_posts, merge.create_posts),
    "new_comments_in_place": _in_place("comments", batches.new_comments, merge.create_comments),
    "post_edits_in_place": _in_place("posts", batches.post_edits, lambda t, b: merge.edit_messages(t, POST, b)),
    "comment_edits_in_place": _in_place("comments", batches.comment_edits, lambda t, b: merge.edit_messages(t, COMMENT, b)),
    "create_users": _with_batch(lambda t, b: merge.create_users(t, b).table, batches.new_users),
    "create_users_outcomes": _with_batch(lambda t, b: merge.create_users(t, b).outcomes, batches.new_users),
    "edit_users": _with_batch(lambda t, b: merge.edit_users(t, b).table, batches.user_edits),
    "edit_users_outcomes": _with_batch(lambda t, b: merge.edit_users(t, b).outcomes, batches.user_edits),
    "edit_users_chained": _with_batch(lambda t, b: merge.edit_users(t, b).table, batches.moving_users),
    "edit_users_chained_outcomes": _with_batch(lambda t, b: merge.edit_users(t, b).outcomes, batches.moving_users),
    "create_users_chained": _with_batch(lambda t, b: merge.create_users(t, b).table, batches.contesting_users),
    "create_users_chained_outcomes": _with_batch(
        lambda t, b: merge.create_users(t, b).outcomes, batches.contesting_users
    ),
    "confirm_users_outcomes": _with_batch(merge.confirmations, batches.mixed_confirmations),
    "confirm_users": _with_batch(merge.confirm_users, batches.confirmations),
    "delete_posts": _with_batch(_delete_posts, batches.post_deletions),
    "delete_post_requests": _with_batch(
        lambda t, b: cascade.delete_requests(t, POST, b), batches.post_deletions
    ),
    "delete_comments": _on_tables(_delete_comments),
    "delete_comment_requests": _on_tables(
        lambda t: cascade.delete_requests(t, COMMENT, batches.comment_deletions(t.comments))
    ),
    "delete_users": _on_tables(_delete_users),
}
