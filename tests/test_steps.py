"""What a plan over whole tables leaves on disk."""

import os
import re
import time
import uuid

import pytest
from pyspark.sql import functions as F

from agora.operators import entries, grams
from agora.operators.messages import cards
from agora.operators.pinning import distilled, pin
from agora.plans import details, feeds, profiles, threads
from agora.schema import COMMENT
from agora.session import shared_dir
from agora.sources.nested import read_records, write_records
from agora.sources.stored import BUCKET


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(frame):
    return plan(frame).count("Exchange hashpartitioning")


def files(path):
    return [f"{folder}/{f}" for folder, _, names in os.walk(path) for f in names if f.startswith("part-")]


@pytest.fixture
def big(spark):
    """Tables too big to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def tables(world):
    people = [world.user() for _ in range(4)]
    for k in range(5):
        post = world.post(author=people[k % 4])
        first = world.comment(post, people[(k + 1) % 4])
        world.comment(post, people[(k + 2) % 4], first)
        world.engage("Comment", first, post, reposts=k % 3, likes=1)
        world.follow(people[k % 4], people[(k + 1) % 4])
    return world.tables()


def test_a_pinned_frame_leaves_no_shuffle(spark):
    def shuffles():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(k).getName() for k in range(held.size()) if held.apply(k).getName().startswith("shuffle_")}

    before = shuffles()
    frame = spark.range(5000).selectExpr("id % 7 AS key", "uuid() AS text").groupBy("key").agg(F.collect_list("text").alias("texts"))
    pinned = pin(frame)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert pinned.rows == pinned.frame.count() == frame.count() == 7


def test_steps_on_the_way_are_deleted(spark):
    paths = []

    def make():
        first = pin(spark.range(9)).frame
        paths.append(first.inputFiles()[0])
        return first.filter("id > 2")

    last = distilled(spark, make)
    assert last.rows == 6 and last.frame.count() == 6
    assert not os.path.exists(paths[0].removeprefix("file://"))


def test_an_index_is_written_by_the_tasks_that_have_it(spark):
    path = f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    grams.write_index(spark.range(0, 30, 1, 3).selectExpr("id", "'why' AS gram"), path, 4)
    assert len(files(path)) == 3 and spark.read.parquet(path).count() == 30


@pytest.mark.parametrize(("most", "page"), [(grams.MOST_BITS, grams.PAGE), (512, 2)])
def test_wanted_grams_pass_and_few_others(spark, monkeypatch, most, page):
    monkeypatch.setattr(grams, "MOST_BITS", most)
    monkeypatch.setattr(grams, "PAGE", page)
    index = spark.range(4000).selectExpr("id", "CONCAT('g', id) AS gram", f"0 AS {BUCKET}")
    wanted = pin(spark.range(0, 4000, 100).selectExpr("CONCAT('g', id) AS gram"))
    passed = {r.id for r in grams.among(index, wanted).collect()}
    assert set(range(0, 4000, 100)) <= passed and len(passed) < 800


def test_only_reposts_are_moved_to_their_reposters(spark, tables, big, monkeypatch):
    asked = []
    join = entries.many_to_one

    def watched(facts, dim, on, *more, **named):
        if on == ["reposter_id"]:
            asked.append(facts.filter("reposter_id IS NULL").count())
        return join(facts, dim, on, *more, **named)

    monkeypatch.setattr(entries, "many_to_one", watched)
    shown = profiles.profile_comments_all(tables, 1).collect()
    assert asked == [0]
    assert len(shown) == tables.comments.count() + tables.reposts.filter("type LIKE 'Comment%'").count()


def test_cards_move_for_their_last_joins_alone(spark, tables, big):
    assert exchanges(cards(tables, COMMENT, 1)) == 3


def test_threads_read_finished_cards(spark, tables, big):
    shown = threads.comment_threads_all(tables, 1)
    joins = re.findall(r"SortMergeJoin \[(\w+?)#", plan(shown))
    assert "id" in joins and not {"author_id", "parent_id", "post_id"} & set(joins)
    assert shown.filter("show_type = 'OriginalCommentReply'").count() == 5


def test_comments_meet_their_posts_last(spark, tables, big):
    for shown, some in (
        (threads.user_comments_all(tables), "parent IS NOT NULL"),
        (details.comment_details_all(tables, 1), "size(replies) = 1 AND parent IS NULL"),
    ):
        joins = re.findall(r"SortMergeJoin \[(\w+?)#", plan(shown))
        assert "post_id" in joins and not {"parent_id", "comment_id"} & set(joins)
        assert shown.filter(some).count() == 5


def test_records_are_written_by_the_tasks_that_have_them(spark):
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    rows = spark.range(0, 8, 1, 4).withColumnRenamed("id", "key")
    write_records(rows, "key", path, 1, dealt=True)
    assert len(files(path)) == 4
    assert sorted(r.key for r in read_records(spark, path, rows.schema).collect()) == list(range(8))


def test_marks_are_found_before_rows_are_wide(spark, tables, big):
    feed = feeds.home_feed_all(tables)
    assert "followee_id" not in plan(feed) and "user_followed" in feed.columns
    assert feed.filter("user_followed").count() > 0
