"""Batches applied to stored buckets: the rows of the whole-table jobs, and only the named buckets written."""

import os
import uuid
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from agora.plans import feeds, merge, threads
from agora.plans.writeback import apply_in_place, touched_buckets
from agora.schema import COMMENT, POST, SCHEMAS
from agora.session import shared_dir
from agora.sources.stored import BUCKET, INDEX, MONTHS, bucket_of, read_bucketed, write_bucketed, write_layout
from tests.conftest import START
from tests.test_layout import rows, scans

BUCKETS = 16
EDGES = "seq long, action string, id long, type string, user_id long, message_id long, created_at timestamp_ntz"
POSTS = "seq long, id long, text string, author_id long, created_at timestamp_ntz"
COMMENTS = "seq long, id long, text string, post_id long, author_id long, parent_id long, created_at timestamp_ntz"
EDITS = "seq long, actor_id long, id long, text string"


@pytest.fixture
def small(world):
    people = [world.user() for _ in range(6)]
    for k in range(30):
        post = world.post(author=people[k % 6], created_at=START - timedelta(days=11 * k))
        top = world.comment(post, people[(k + 1) % 6])
        world.comment(post, people[(k + 2) % 6], parent=top)
        world.like("Post", post, people[(k + 3) % 6])
        world.repost("Comment", top, people[(k + 5) % 6])
    return world.tables()


def store(spark, tables):
    path = f"{shared_dir(spark)}/writeback-{uuid.uuid4().hex}"
    write_layout(spark, path, BUCKETS)
    for name, frame in tables.items():
        write_bucketed(frame, name, path, BUCKETS)
    return read_bucketed(spark, path), path


def files(path, name):
    """{folder: names of its files}"""
    root = f"{path}/{name}".removeprefix("file://").removeprefix("file:")
    return {d: sorted(f for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet")) for d in os.listdir(root) if "=" in d}


def same_as_whole(spark, small, name, batch, job):
    """Check rows and outcomes, and that no file outside the named buckets changed."""
    cut, path = store(spark, small)
    before = files(path, name)
    named = {f"{BUCKET}={r[BUCKET]}" for r in touched_buckets(cut.layout, name, batch).frame.collect()}
    whole = job(small, batch)
    wanted, outcomes = rows(whole.table.select(*SCHEMAS[name].names)), rows(whole.outcomes)
    done = apply_in_place(cut, name, path, batch, job)
    assert rows(getattr(done.tables, name)) == wanted
    assert rows(done.outcomes) == outcomes
    again = read_bucketed(spark, path)
    assert rows(getattr(again, name)) == wanted
    after = files(path, name)
    assert {d: f for d, f in before.items() if d not in named} == {d: f for d, f in after.items() if d not in named}
    assert 0 < len(named) < len(before)
    misplaced = again.layout.frames[name].filter(F.col(BUCKET) != bucket_of(F.col({"posts": "id", "comments": "post_id"}.get(name, "message_id")), BUCKETS))
    assert misplaced.count() == 0
    return again, path


def likes(tables, batch):
    return merge.apply_edges(tables, "likes", batch)


def test_likes_come_and_go_and_an_emptied_bucket_goes(spark, small):
    gone = small.likes.filter(bucket_of(F.col("message_id"), BUCKETS) == bucket_of(F.lit(5), BUCKETS)).collect()
    asked = [(k, "delete", None, r.type, r.user_id, r.message_id, START) for k, r in enumerate(gone)]
    asked += [(90, "insert", 900, "CommentLike", 1, 7, START), (91, "insert", 901, "PostLike", 1, 999, START)]
    batch = spark.createDataFrame(asked, EDGES)
    again, path = same_as_whole(spark, small, "likes", batch, likes)
    emptied = again.likes.filter(bucket_of(F.col("message_id"), BUCKETS) == bucket_of(F.lit(5), BUCKETS))
    assert emptied.count() == 0


def test_new_posts_are_in_their_months_too(spark, small):
    asked = [(1, 500, "Who?", 1, START - timedelta(days=40)), (2, 501, "No", 1, START), (3, 502, "When?", 99, START), (4, 503, "Where?", 2, START + timedelta(days=90))]
    again, _ = same_as_whole(spark, small, "posts", spark.createDataFrame(asked, POSTS), merge.create_posts)
    assert rows(again.layout.months.select(*again.posts.columns)) == rows(again.posts)
    assert {500, 503} <= {r.id for r in again.posts.collect()}


def test_edited_posts(spark, small):
    asked = [(1, 1, 1, "Changed?"), (2, 1, 2, "Not mine?"), (3, 1, 777, "Unknown?"), (4, 1, 1, "Changed again?")]
    job = lambda t, b: merge.edit_messages(t, POST, b)
    again, path = same_as_whole(spark, small, "posts", spark.createDataFrame(asked, EDITS), job)
    assert rows(again.layout.months.select(*again.posts.columns)) == rows(again.posts)
    assert all(len(found) == 1 for found in files(path, MONTHS).values())


def test_new_comments_with_parents_elsewhere(spark, small):
    asked = [
        (1, 500, "Top?", 3, 1, None, START),
        (2, 501, "Reply?", 3, 2, 500, START),
        (3, 502, "Wrong post?", 4, 2, 1, START),
        (4, 503, "No parent?", 4, 2, 9999, START),
        (5, 504, "Stored parent?", 1, 2, 1, START),
    ]
    again, _ = same_as_whole(spark, small, "comments", spark.createDataFrame(asked, COMMENTS), merge.create_comments)
    assert rows(again.layout.index.select("id", "post_id")) == rows(again.comments.select("id", "post_id"))
    assert {r.id for r in threads.comment_thread(again, 501, 1).collect()} >= {500, 501}


def test_edited_comments_are_found_by_the_index(spark, small):
    mine = small.comments.filter("author_id = 2").first()
    asked = [(1, 2, mine.id, "Changed?"), (2, 2, 4444, "Unknown?")]
    job = lambda t, b: merge.edit_messages(t, COMMENT, b)
    again, path = same_as_whole(spark, small, "comments", spark.createDataFrame(asked, EDITS), job)
    assert again.comments.filter("text = 'Changed?'").count() == 1
    assert len(files(path, INDEX)) > 1


def test_an_empty_batch_changes_no_file(spark, small):
    cut, path = store(spark, small)
    before = {name: files(path, name) for name in ("posts", MONTHS)}
    done = apply_in_place(cut, "posts", path, spark.createDataFrame([], POSTS), merge.create_posts)
    assert {name: files(path, name) for name in ("posts", MONTHS)} == before
    assert rows(done.tables.posts) == rows(small.posts) and done.outcomes.count() == 0


def test_users_and_plain_tables_are_refused(spark, small):
    cut, path = store(spark, small)
    with pytest.raises(ValueError, match="unique"):
        apply_in_place(cut, "users", path, spark.createDataFrame([], POSTS), merge.create_users)
    with pytest.raises(ValueError, match="buckets"):
        apply_in_place(small, "posts", path, spark.createDataFrame([], POSTS), merge.create_posts)
    with pytest.raises(ValueError, match="say"):
        apply_in_place(cut, "likes", path, spark.createDataFrame([], POSTS), merge.create_posts)


def test_a_limited_feed_reads_only_the_newest_months(spark, small):
    cut, _ = store(spark, small)
    for limit in (1, 3, 7, 29, 100):
        assert rows(feeds.popular_feed(cut, 1, limit)) == rows(feeds.popular_feed(small, 1, limit))
    newest = feeds._first_day_needed(cut, 3)
    assert newest == feeds._first_day_needed(small, 3)
    assert feeds._first_day_needed(cut, 1000) is None
    read, plan = scans(feeds._months_since(cut, newest))[0]
    assert "PartitionFilters: [isnotnull(month" in plan or "month#" in plan.split("PartitionFilters")[1]
    assert read < len(cut.layout.months.inputFiles()) / 2
    assert cut.with_(posts=small.posts).layout.months is None
