import os
import random

import pytest

from agora.operators import joins, pinning
from agora.operators.engagement import engagement
from agora.operators.ordered import with_previous
from agora.schema import POST


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, no_broadcast, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    rng = random.Random(1)
    facts = spark.createDataFrame(
        [(i, 1 if rng.random() < 0.4 else rng.choice([None, *range(2, 40)])) for i in range(600)], "id long, key long"
    )
    dim = spark.createDataFrame([(k, v) for k in range(1, 30) for v in range(1 + k % 2)], "key long, value long")
    plan = joins.many_to_one(facts, dim, ["key"], how)
    assert "__salt" in plan._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(plan.select("id", "key", "value").collect(), key=str)
    assert got == sorted(facts.join(dim, "key", how).select("id", "key", "value").collect(), key=str)


def test_hot_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 0.1)
    rows = spark.range(100).selectExpr("CAST(sqrt(id) AS LONG) AS key")
    assert {r.key for r in joins.hot_keys(rows, ["key"], rows=1).collect()} == {5, 6, 7, 8, 9}
    assert joins.hot_keys(rows, ["key"], rows=1000).count() == 0


def test_no_hot_key_is_left_out(spark):
    rows = spark.range(30_000).selectExpr("id % 3000 AS key")
    assert joins.hot_keys(rows, ["key"], rows=10).count() == 3000


def test_one_small_table_does_not_make_a_side_small(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20kb")
    try:
        few = pinning.pin(spark.range(3)).frame
        many = pinning.pin(spark.range(50_000).selectExpr("id", "id AS value")).frame
        both = few.selectExpr("id", "id AS value").unionByName(many)
        dim = both.groupBy("id").agg({"value": "max"})
        plan = joins.many_to_one(spark.range(10), dim, ["id"], sized_by=both)
        # Salted: not broadcast because one of the tables behind it is small.
        assert "__salt" in plan._jdf.queryExecution().optimizedPlan().toString()
        assert joins.fits_broadcast(few, joins.WIDENED) and not joins.fits_broadcast(both, joins.WIDENED)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keep_and_drop_found(spark, no_broadcast, monkeypatch):
    facts = spark.range(20).selectExpr("id", "id % 5 AS key")
    keys = pinning.pin(spark.createDataFrame([(1,), (3,), (9,)], "key long"))
    for rows in (100, 0):
        monkeypatch.setattr(pinning, "BROADCAST_ROWS", rows)
        kept = {r.id for r in joins.keep_found(facts, keys, ["key"]).collect()}
        assert kept == {i for i in range(20) if i % 5 in (1, 3)}
        assert {r.id for r in joins.drop_found(facts, keys, ["key"]).collect()} == set(range(20)) - kept


def test_pin_counts_and_keeps_rows(spark):
    pinned = pinning.pin(spark.range(7))
    assert pinned.rows == 7 and pinned.small and pinned.frame.count() == 7
    none = pinning.pin(spark.range(7).filter("id < 0"))
    assert none.rows == 0 and none.frame.collect() == []


def test_a_request_leaves_nothing_behind(spark):
    kept = pinning.pin(spark.range(3))
    with pinning.request(spark):
        paths = [pinning.pin(spark.range(5)).frame.inputFiles()[0] for _ in range(2)]
        assert all(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert kept.frame.count() == 3


def test_few_or_all(spark, monkeypatch):
    monkeypatch.setattr(pinning, "BROADCAST_ROWS", 5)
    rows = spark.range(5)
    frame, few = pinning.few_or_all(rows)
    assert few.rows == 5 and frame.count() == 5
    rows = spark.range(50)
    frame, few = pinning.few_or_all(rows)
    assert few is None and frame is rows


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_previous_of_a_hot_key(spark, block):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaab"), rng.choice(["insert", "delete"])) for i in range(60)]
    last, want = {}, {}
    for seq, key, action in rows:
        want[seq] = last.get(key)
        last[key] = action
    frame = spark.createDataFrame(rows, "seq long, key string, action string")
    got = with_previous(frame, ["key"], "seq", "action", "before", block)
    assert {r.seq: r.before for r in got.collect()} == want


def test_engagement_counts_each_source_once(world):
    post = world.post()
    comment = world.comment(post)
    world.engage("Post", post, post, reposts=2, likes=3, comments=1)
    world.engage("Comment", comment, post, reposts=1, comments=2)
    me = world.user()
    world.like("Post", post, me)
    tables = world.tables()
    rows = {(r.kind, r.id): r for r in engagement(tables, "Post", "Comment", viewer=me).collect()}
    assert rows["Post", post][2:] == (4, 2, 2, True, False)
    assert rows["Comment", comment][2:] == (0, 1, 2, False, False)
    only = pinning.pin(tables.posts.selectExpr("'Post' AS kind", "id"))
    assert engagement(tables, POST, viewer=me, only=only).collect() == [rows["Post", post]]
