import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from agora.llm.components import Forest, components
from agora.llm.common import group_starts
from agora.llm.simhash import VantageTrees, fingerprint, fingerprints, near_points, simhash_components, vantage_pairs


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    return [min(ids[k] for k in range(len(ids)) if find(k) == find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", "  \n", "One", "ONE two THREE", "a b c d", "É À   x y z w", "a a a a a a", "w " * 5000])
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_components_match_brute_force(docs):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(150)]
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "  "), (903, rows[0][1]), (903, rows[0][1])]
    rng.shuffle(rows)
    found = simhash_components(docs(rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], prints, plain_components([i for i, _ in rows], prints), strict=True))
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == want


def test_crowded_shards_are_split_and_lose_nothing(spark):
    rng = random.Random(5)
    center = rng.getrandbits(63)
    points = {center}
    while len(points) < 300:
        points.add(center ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(1, 9))))
    points |= {rng.getrandbits(63) for _ in range(100)}
    frame = spark.createDataFrame([(p,) for p in points], "fp long")
    found = {r.node: r.root for r in components(near_points(frame, len(points), split=20)).collect()}
    ids = sorted(points)
    want = dict(zip(ids, plain_components(ids, ids), strict=True))
    assert {p: found.get(p, p) for p in ids} == want


def test_vantage_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 2**20, 700, dtype=np.uint64)
    got = {(i, j) for a, b in vantage_pairs(points, 3) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    assert list(vantage_pairs(np.full(200, 7, dtype=np.uint64), 4))


def test_trees_of_many_shards(monkeypatch):
    monkeypatch.setattr("agora.llm.simhash.VISITS", 100)
    rng = np.random.default_rng(2)
    shard = np.sort(rng.integers(0, 40, 400))
    points = rng.integers(0, 2**12, 400, dtype=np.uint64)
    trees = VantageTrees(points, group_starts(pa.table({"s": shard}), ["s"]))
    assert sorted(trees.vantage.tolist()) == list(range(400))
    got = sorted((i, j) for a, b in trees.pairs(4) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    near = (np.bitwise_count(points[:, None] ^ points[None, :]) <= 4) & (shard[:, None] == shard[None, :])
    assert got == [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True) if i < j]


def test_branches_are_pruned():
    rng = np.random.default_rng(3)
    places = rng.integers(0, 57, 2000).astype(np.uint64)
    points = ((np.uint64(1) << places) - np.uint64(1)) << np.uint64(7) | rng.integers(0, 128, 2000, dtype=np.uint64)
    trees = VantageTrees(points, np.array([0]))
    found = sum(len(i) for i, _ in trees.pairs(4))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    assert found == (near.sum() - 2000) // 2 and trees.visits < 2000 * 2000 / 2


def test_pairs_of_the_given_documents_come_from_trees(spark):
    """Every shard of more than one point is searched as a tree, and nothing else finds its pairs."""
    rows = fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct().toPandas()
    points = rows["fp"].to_numpy()
    points = points[np.argsort(points & 0xFFF, kind="stable")]
    starts = group_starts(pa.table({"s": points & 0xFFF}), ["s"])
    trees = VantageTrees(points.view(np.uint64), starts)
    got = {(i, j) for a, b in trees.pairs(4) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = set()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(points)], strict=True):
        want |= {(i, j) for i in range(a, b) for j in range(i + 1, b) if bin(int(points[i] ^ points[j]) % 2**64).count("1") <= 4}
    assert got == want and trees.visits > len(points)


def test_long_chains_of_links(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_forest_links():
    forest = Forest(6)
    forest.link(np.array([5, 3, 1]), np.array([3, 1, 4]))
    assert forest.roots().tolist() == [0, 1, 2, 1, 1, 1]


def test_empty_table_and_null_ids(docs):
    assert simhash_components(docs([])).collect() == []
    rows = simhash_components(docs([(None, "a b c d e"), (4, "a b c d e"), (None, "other words are here now")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash_components(docs([(1, "x")])).select(F.hex("fp")).count() == 1
