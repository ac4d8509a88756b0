"""Tables in buckets: the same answers from fewer files."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from agora.operators import pruning
from agora.operators.pinning import pin
from agora.plans import feeds, threads
from agora.schema import COMMENT, POST
from agora.session import shared_dir
from agora.sources import driverdata
from agora.sources.stored import SCHEMAS, read_bucketed, write_bucketed, write_layout

SF = "/root/testdata/sf0.001"


def stored(spark, tables, buckets, files=1):
    path = f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"
    write_layout(spark, path, buckets)
    for name, frame in tables.items():
        write_bucketed(frame, name, path, buckets, files)
    return read_bucketed(spark, path)


def scans(frame):
    """(files, partitions, plan text) of every table scan of an executed frame."""
    frame.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            metrics = node.metrics()
            return [(metrics.apply("numFiles").value(), node.simpleString(400))]
        below = node.children()
        return [s for k in range(below.size()) for s in walk(below.apply(k))]

    return walk(frame._jdf.queryExecution().executedPlan())


@pytest.fixture
def small(world):
    people = [world.user() for _ in range(8)]
    posts = [world.post(author=people[k % 8]) for k in range(40)]
    for k, post in enumerate(posts):
        top = world.comment(post, people[(k + 1) % 8])
        reply = world.comment(post, people[(k + 2) % 8], parent=top)
        world.like("Post", post, people[(k + 3) % 8])
        world.like("Comment", reply, people[(k + 4) % 8])
        world.repost("Comment", top, people[(k + 5) % 8])
        world.repost("Post", post, people[(k + 6) % 8])
    for k in range(7):
        world.follow(people[k], people[k + 1])
    loner = world.user()
    world.post(author=loner)
    world.repost("Comment", 8, loner)
    return world.tables()


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_same_rows_with_and_without_buckets(spark, small):
    cut = stored(spark, small, 7, files=2)
    for name, frame in small.items():
        assert getattr(cut, name).columns == SCHEMAS[name].names
        assert rows(getattr(cut, name)) == rows(frame)
    assert not cut.with_(posts=cut.posts).layout.knows("posts") and cut.with_(posts=cut.posts).layout.knows("likes")
    for ask in (
        lambda t: threads.post_thread(t, 5, 2),
        lambda t: threads.post_thread(t, 999, 2),
        lambda t: threads.comment_thread(t, 8, 3),
        lambda t: threads.comment_thread(t, 7),
        lambda t: threads.comment_thread(t, 999),
        lambda t: threads.post_detail(t, 5, 2),
        lambda t: threads.comment_detail(t, 8, 3),
        lambda t: feeds.home_feed(t, 3),
    ):
        assert rows(ask(cut)) == rows(ask(small))


def test_near_holds_all_that_is_looked_up(spark, small):
    cut = stored(spark, small, 7)
    entries = pin(spark.createDataFrame([(COMMENT, 8), (POST, 3)], "kind string, id long"))
    found = pruning.near(cut, entries)
    posts = {8: 4}  # comment 8 is on post 4
    assert {3, posts[8]} <= {r.id for r in found.posts.collect()}
    assert {r.id for r in small.comments.filter(F.col("post_id").isin(3, 4)).collect()} <= {r.id for r in found.comments.collect()}
    wanted = small.likes.filter(F.col("message_id").isin(3, 8))
    assert rows(found.likes.filter(F.col("message_id").isin(3, 8))) == rows(wanted)
    many = pin(small.posts.select(F.lit(POST).alias("kind"), "id"))
    assert pruning.near(cut, many) is cut


def test_only_needed_buckets_are_read(spark, small):
    cut = stored(spark, small, 32)
    entries = pin(spark.createDataFrame([(COMMENT, 8), (POST, 3)], "kind string, id long"))
    found = pruning.near(cut, entries)
    for name in ("posts", "comments", "likes", "reposts"):
        files, plan = scans(getattr(found, name))[0]
        assert "dynamicpruning" in plan, name
        assert 1 <= files <= 2, name
    assert "BucketedScan" not in scans(pruning.rows_at(cut, "posts", "id", 3))[0][1]
    assert scans(pruning.rows_at(cut, "posts", "id", 3))[0][0] == 1
    assert scans(pruning.rows_at(cut, "posts", "author_id", 3))[0][0] > 10
    assert min(files for files, _ in scans(pruning.thread_around(cut, 8))) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("ask", [lambda t: threads.post_thread(t, 21, 1), lambda t: threads.comment_thread(t, 3, 1)])
def test_threads_read_at_most_half_the_files(spark, ask):
    assert_half(driverdata.load(spark, SF), ask)


def test_a_home_feed_reads_at_most_half_the_files(spark, small):
    """Of what its entries look up; finding the entries themselves is not counted."""
    assert_half(stored(spark, small, 64), lambda t: feeds.home_feed(t, 9))


def assert_half(tables, ask):
    every = {name: len(getattr(tables, name).inputFiles()) for name in ("posts", "comments", "likes", "reposts")}
    found = [(files, plan) for files, plan in scans(ask(tables)) if "dynamicpruning" in plan]
    assert found
    assert sum(files for files, _ in found) <= len(found) * min(every.values()) / 2
