"""What keeps a step in proportion to its input."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from agora.operators import grams, joins, nesting
from agora.operators.pinning import BROADCAST_ROWS, Pinned, pin
from agora.session import shared_dir
from agora.sources import driverdata, stored
from agora.sources.nested import read_records, write_records

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_records_are_written_compressed(spark):
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    rows = spark.range(200).selectExpr("id AS key", "array(named_struct('text', repeat('why ', 50))) AS list")
    write_records(rows, "key", path, 3)
    written = [f for _, _, files in os.walk(path) for f in files if f.startswith("part-")]
    assert written and all(f.endswith(".json.gz") for f in written)
    assert sorted(read_records(spark, path, rows.schema).select("key", "list").collect()) == sorted(rows.collect())


def test_short_lists_are_gathered_in_one_shuffle(spark, monkeypatch):
    rows = spark.range(60).selectExpr("IF(id % 7 = 0, NULL, id % 7) AS owner", "id", "timestamp_seconds(id % 9) AS created_at")
    ranked = {(r.owner, r.part): [x.id for x in r.list] for r in nesting.nest(rows, "owner", ["id"], "list", part_rows=4).collect()}

    def refuse(*_):
        raise AssertionError("no list is long")

    monkeypatch.setattr(nesting, "ranked_in_ranges", refuse)
    nested = nesting.nest(rows, "owner", ["id"], "list", part_rows=20)
    assert plan(nested).count("Exchange hashpartitioning") == 1
    whole = {r.owner: [x.id for x in r.list] for r in nested.collect()}
    for owner, ids in whole.items():
        assert ids == [k for _, k in sorted(((k % 9, k) for k in range(60) if k % 7 == owner), reverse=True)]
        assert ids == [k for part in range(3) for k in ranked.get((owner, part), [])]
    assert sorted(whole) == list(range(1, 7))


def test_counts_of_ranges_are_broadcast(spark):
    rows = spark.range(300).selectExpr("id % 3 AS owner", "id")
    ranked = nesting.ranked_in_ranges(rows, "owner", [F.asc("id")], "place")
    assert "SortMergeJoin" not in plan(ranked) and all(r.place == r.id // 3 + 1 for r in ranked.collect())


def test_many_keys_in_small_files_are_not_broadcast(spark):
    facts, keys = spark.range(50).selectExpr("id", "id AS value"), pin(spark.range(40, 60))
    many = Pinned(keys.frame, BROADCAST_ROWS + 1)
    for found, kept in ((joins.keep_found, set(range(40, 50))), (joins.drop_found, set(range(40)))):
        joined = found(facts, many, ["id"])
        assert "SortMergeJoin" in plan(joined)
        assert {r.id for r in joined.collect()} == kept
        left = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in left.split("Initial Plan")[0]
    assert "SortMergeJoin" in plan(facts.join(many.hinted(), "id", "left"))


def test_only_heavy_cells_are_counted_by_key(spark):
    rows = spark.range(5000).selectExpr("IF(id < 2000, 7, id) AS key").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS key"))
    hot = joins.hot_keys(rows, ["key"], rows=1000)
    assert "__cell" in plan(hot) and [r.key for r in hot.collect()] == [7]
    assert joins.hot_keys(rows.limit(0), ["key"], rows=1).count() == 0


@pytest.mark.parametrize("digits", [3, 4, 5, 6, 7])
def test_candidates_do_not_grow_with_texts_times_terms(spark, digits):
    rows = spark.range(20_000).selectExpr("id", "concat('user_', lpad(CAST(id * 7919 % 1000000 AS STRING), 9, '0')) AS text")
    path = f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    grams.write_index(grams.text_index(rows, ["text"]), path, 4)
    index = spark.read.schema(f"id long, gram string, {stored.BUCKET} int").parquet(path)
    asked = spark.range(500).selectExpr(f"concat('_', right(concat('000000', CAST(id * 1999 AS STRING)), {digits})) AS term").distinct()
    asked = asked.selectExpr("substring(term, 2) AS term")
    found = grams.matching(rows, ["text"], index, asked, 4).count()
    terms = [r.term for r in asked.collect()]
    texts = [r.text for r in rows.collect()]
    assert found == sum(t in text for t in terms for text in texts)
    if digits >= 5:
        assert grams.candidates(index, asked, 4).count() <= 20 * len(terms) + found


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_comments_are_mapped_in_one_shuffle(spark):
    assert plan(driverdata.comments(spark, SF)).count("Exchange hashpartitioning") == 1


def test_a_large_bucket_is_split_over_tasks(spark):
    rows = spark.range(40_000).selectExpr("1L AS id", "repeat(sha2(CAST(id AS STRING), 256), 2) AS text", "1L AS author_id", "timestamp_ntz'2024-01-01' AS created_at")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300kb")
    path = f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"
    try:
        stored.write_bucketed(rows, "posts", path, 2)
    finally:
        spark.conf.set(key, before)
    written = [f for _, _, files in os.walk(f"{path}/posts") for f in files if f.startswith("part-")]
    assert len(written) > 1 and stored.read_table(spark, "posts", path).count() == 40_000


def test_few_named_rows_are_moved_alone(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    facts = spark.range(900).selectExpr("IF(id % 10 = 0, NULL, id % 7) AS key", "id")
    dim = spark.range(3000).selectExpr("id AS key", "id * 2 AS value").filter("key != 3")
    for how in ("inner", "left"):
        few = joins.many_to_one(facts, dim, ["key"], how, few_from=facts)
        assert "SortMergeJoin" not in plan(few)
        assert sorted(few.collect(), key=str) == sorted(joins.many_to_one(facts, dim, ["key"], how).collect(), key=str)


def test_without_hot_keys_a_side_is_not_shuffled_again(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    facts, dim = spark.range(50).selectExpr("id % 9 AS key", "id"), spark.range(20).selectExpr("id AS key")
    joined = joins.many_to_one(facts, dim.repartition("key"), ["key"])
    assert plan(joined).count("Exchange hashpartitioning") == 2 and "__salt" not in plan(joined)
    assert joined.count() == 50


def test_one_window_where_no_key_has_a_block_of_rows(spark):
    rows = spark.range(40).selectExpr("IF(id % 4 = 0, NULL, id % 4) AS key", "id")
    assert joins.any_hot(rows, ["key"], 10) and not joins.any_hot(rows, ["key"], 41)
    assert not joins.any_hot(rows.limit(0), ["key"], 1)


def test_dealt_rows_are_written_as_they_lie(spark):
    path = f"{shared_dir(spark)}/dealt-{uuid.uuid4().hex}"
    rows = driverdata.comments(spark, SF)
    stored.write_bucketed(rows, "comments", path, driverdata.BUCKETS, dealt=True)
    got = spark.read.parquet(f"{path}/comments")
    assert got.filter(got.bucket != stored.bucket_of(got.post_id, driverdata.BUCKETS)).count() == 0
    assert got.count() == rows.count()
