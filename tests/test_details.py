"""Nested details, their JSON form, and ranks by ranges."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from agora.operators import nesting
from agora.operators.nesting import nest, ranked_in_ranges
from agora.plans import details, feeds
from agora.session import shared_dir
from agora.sources.nested import read_records, write_records


@pytest.fixture
def tables(world):
    reader, writer, other = world.user("reader"), world.user("writer"), world.user("other")
    post = world.post("Why?", writer)
    world.post("Lonely?", other)
    top = [world.comment(post, other, text=f"Top {k}?") for k in range(5)]
    reply = world.comment(post, writer, parent=top[0], text="Reply?")
    world.comment(post, reader, parent=reply, text="Deep?")
    world.follow(reader, writer)
    return world.tables()


def test_post_details(tables, monkeypatch):
    rows = {r.post_id: r for r in details.post_details_all(tables, 1).collect()}
    assert set(rows) == {1, 2}
    first = rows[1]
    assert first.post.text == "Why?" and first.post.author.username == "writer" and first.post.current_user_following
    assert first.post.comment_count == 5
    assert [c.text for c in first.comments] == [f"Top {k}?" for k in reversed(range(5))]
    assert first.comments[-1].comment_count == 1 and first.comments[0].author.username == "other"
    assert (rows[2].part, rows[2].parts, rows[2].comments) == (0, 0, [])
    assert not rows[2].post.current_user_following


def test_comment_details(tables):
    rows = {r.comment_id: r for r in details.comment_details_all(tables, 1).collect()}
    assert len(rows) == 7
    assert rows[1].parent is None and [r.text for r in rows[1].replies] == ["Reply?"]
    assert rows[6].parent.text == "Top 0?" and rows[6].comment.current_user_following and rows[6].post.id == 1
    assert rows[7].parent.text == "Reply?" and rows[7].replies == [] and not rows[7].comment.current_user_following
    assert not details.comment_details_all(tables).filter("comment.current_user_following").count()


def test_long_lists_come_in_parts(tables):
    listed = nest(tables.comments, "post_id", ["id", "text"], "comments", part_rows=3)
    rows = {r.part: r for r in listed.collect()}
    assert [len(rows[k].comments) for k in range(3)] == [3, 3, 1] and {r.parts for r in rows.values()} == {3}
    assert [c.id for k in range(3) for c in rows[k].comments] == [7, 6, 5, 4, 3, 2, 1]


@pytest.mark.parametrize("make", [details.post_details_all, details.comment_details_all])
def test_records_come_back_from_json(spark, tables, make):
    records = make(tables, 1)
    key = records.columns[0]
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    write_records(records, key, path, 4)
    back = read_records(spark, path, records.schema)
    assert sorted(map(str, back.select(records.columns).collect())) == sorted(map(str, records.collect()))
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(lines) == records.count()
    if key == "comment_id":
        assert any(line["parent"] is None for line in lines) and all("parent" in line for line in lines)


def test_flat_forms(tables):
    posts = details.flat_post_details(details.post_details_all(tables, 1)).collect()
    assert len(posts) == 6 and sum(r.comment_id is None for r in posts) == 1
    comments = details.flat_comment_details(details.comment_details_all(tables, 1))
    assert comments.count() == 7 and comments.filter("reply_id IS NULL").count() == 5


def test_ranks_match_a_window(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"o{rng.randrange(30)}", rng.randrange(1000), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "owner string, score long, id long").repartition(4)
    found = ranked_in_ranges(frame, "owner", [F.desc("score"), F.asc("id")], "place")
    got = {r.id: r.place for r in found.collect()}
    for owner in {o for o, _, _ in rows}:
        order = sorted((-s, k) for o, s, k in rows if o == owner)
        assert [got[k] for _, k in order] == list(range(1, len(order) + 1))


def test_no_task_ranks_a_whole_feed(spark, world, monkeypatch):
    """The rows of one viewer are dealt by ranges, and each range is ranked alone."""
    reader, writer = world.user(), world.user()
    world.follow(reader, writer)
    for k in range(60):
        world.post(f"Post {k}?", writer)
    plans = []
    plain = nesting.pin
    monkeypatch.setattr(nesting, "pin", lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or plain(frame))
    feed = feeds.home_feed_all(world.tables())
    rows = sorted((r.viewer_id, r.position, r.id) for r in feed.collect())
    assert [r[1] for r in rows if r[0] == reader] == list(range(1, 61))
    assert [r[2] for r in rows if r[0] == reader] == list(range(60, 0, -1))
    assert len(plans) == 1 and "rangepartitioning(viewer_id" in plans[0]
    whole = [line for line in plans[0].splitlines() if "Window [" in line and "row_number" in line]
    assert all("post_type" in line or "__range" in line for line in whole)
