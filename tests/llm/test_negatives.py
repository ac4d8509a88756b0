import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm.negatives import OP12_SQL, Tree, Windows, hard_negatives, op12_negatives, pack, tiles, whole_vectors, window_of

SCHEMA = "vec_id long, embedding array<float>, label int, dims string, rank string"


def plain(rows):
    """Hard negatives by comparing every anchor with every row."""
    points = set()
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        points.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    out = []
    for a in (p for p in points if p[0] % 100 == 0):
        scored = [(-sum(x * y for x, y in zip(a[2], p[2], strict=True)), p[0], p[1]) for p in points if len(p[2]) == len(a[2])]
        for s, i, _ in sorted(x for x in scored if x[2] == a[1] and x[1] != a[0])[:5]:
            inside = sorted(x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s)
            out += [(a[0], i, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside[:5])]
    return sorted(out)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(whole_vectors(frame, "vec_id", label, "embedding"), F.col("id") % 100 == 0, **sizes)
    return sorted(tuple(r) for r in found.collect())


def some(seed, n, dims=6, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    rows = []
    for _ in range(n):
        c = rng.choice(centres)
        rows.append((rng.choice([rng.randrange(2000), 100 * rng.randrange(20)]), [x + rng.gauss(0, 0.2) for x in c], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = some(seed, 400)
    rows += [(300, None, 1), (None, rows[0][1], 1), (400, rows[0][1], None), (500, [None] * 6, 2), (600, [float("nan")] * 6, 2), (700, [float("inf")] * 6, 2)]
    rows += [(800, [0.0] * 6, 1), (803, [0.0] * 6, 1), (1003, [0.0] * 6, 2), (1100, [0.5, 0.5], 1), (1101, [0.5, 0.25], 1), (1102, [0.5, 0.25], 3)]
    rows += [rows[3], rows[3], rows[4], (1200, [], 1), (1201, [], 1), (1202, [], 2)]
    want = plain(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    if seed == 1:
        assert mined(spark, rows, leaf=4, tree=8, block=20) == want


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(100, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)] + [(i, [0.9, 0.1 * (i % 3)], 2) for i in range(40, 20, -1) if i % 7]
    assert mined(spark, rows, leaf=2) == plain(rows)
    assert [r[3] for r in mined(spark, rows)] == [22, 23, 24, 25, 26]


def test_one_label_with_a_third_of_all_rows(spark):
    rows = [(i, e, 1 if i % 3 == 0 else label) for i, e, label in some(5, 600)]
    assert mined(spark, rows, leaf=8) == plain(rows)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(101, [1.0], 1), (102, [1.0], 2)]) == []


def test_large_components_stay_exact(spark):
    rows = [(100, [30000.0, 1.0], 1), (1, [30000.0, 3.0], 1), (2, [30000.0, 2.0], 2), (3, [29999.0, 1.0], 2), (4, [1e30, 1.0], 2)]
    assert mined(spark, rows) == plain([r for r in rows if r[0] != 4])


def test_windows():
    assert window_of(10) == (8, 10) and window_of(11) == (9, 11) and window_of(0) == (0, 0)
    low, high = window_of(-10)
    assert low > high
    for s in range(-30, 30):
        low, high = window_of(s)
        assert [t for t in range(-50, 50) if 80 * s <= 100 * t <= 100 * s] == list(range(low, high + 1))


def test_tiles_hold_every_row_once():
    rng = np.random.default_rng(1)
    for n, dims in ((0, 3), (1, 3), (500, 1), (1000, 5), (777, 20)):
        vectors = rng.integers(-50, 50, (n, dims))
        found = list(tiles(vectors, 16))
        assert sorted(np.concatenate(found).tolist() if found else []) == list(range(n))
        assert all(len(t) <= 16 for t in found)


def test_the_tree_prunes_and_misses_nothing():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 100, (40, 8))
    vectors = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 8))).astype(np.int64)
    leaves = [(0, t.astype(np.int64), vectors[t], vectors[t].min(axis=0), vectors[t].max(axis=0)) for t in tiles(vectors, 32)]
    tree = Tree(leaves, np.float64)
    for n in range(20):
        query = vectors[rng.integers(0, 4000)].astype(float)
        scores = (vectors @ query).astype(np.int64)
        top = int(scores.max())
        windows = [window_of(top), window_of(top // 2)]
        wanted = Windows([f for f, _ in windows], [c for _, c in windows], 5)
        tree.search(query, 1, False, wanted)
        for (low, high), (s, i) in zip(windows, wanted.found, strict=True):
            order = [k for k in np.lexsort((np.arange(4000), -scores)) if low <= scores[k] <= high][:5]
            assert i.tolist() == order and s.tolist() == scores[order].tolist()
    assert 0 < tree.opened < 20 * len(leaves) / 4


def test_index_holds_every_row(spark):
    rows = spark.createDataFrame([(i, e, label, "", "") for i, e, label in dict((r[0], r) for r in some(9, 500)).values()], SCHEMA)
    points = whole_vectors(rows, "vec_id", F.col("label"), "embedding")
    leaves = pack(points, 16).collect()
    assert sum(len(r.ids) // 8 for r in leaves) == rows.count()
    assert all(len(r.ids) <= 128 for r in leaves)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cursor = connection.execute(OP12_SQL)
    names = [d[0] for d in cursor.description]
    found = op12_negatives(spark, sf)
    assert found.columns == names and dict(found.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in found.collect()) == sorted(cursor.fetchall())
