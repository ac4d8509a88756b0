import numpy as np
import pyarrow as pa
import pytest

from agora.llm.embeddings import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, pass string"


def plain(rows, least):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {i: np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) for i, v, _, _ in rows if sound(v)}
    label = {i: lab for i, _, lab, _ in rows}
    near = {i: set() for i, *_ in rows}
    for i in unit:
        for j in unit:
            if i < j and label[i] is not None and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                near[i].add(j), near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        out[i] = (len(near[i]), min(seen), i == min(seen))
    return out


@pytest.mark.parametrize(("block", "window", "crowd"), [(1024, 32, 8192), (7, 4, 8192), (1024, 2, 5)])
def test_links_match_brute_force(spark, monkeypatch, block, window, crowd):
    monkeypatch.setattr("agora.llm.embeddings.BLOCK", block)
    monkeypatch.setattr("agora.llm.embeddings.WINDOW", window)
    monkeypatch.setattr("agora.llm.embeddings.CROWD", crowd)
    rng = np.random.default_rng(4)
    rows = []
    for center in rng.standard_normal((15, 16)):
        for _ in range(12):
            v = center + rng.standard_normal(16) * rng.choice([0.05, 0.25, 0.35])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(rng.integers(2)), "p"))
    rows += [(len(rows) + k, rows[3][1], rows[3][2], "p") for k in range(5)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(1000 + k, v, 1, "p") for k, v in enumerate(odd)]
    rows += [(1100, rows[0][1], None, "p"), (1101, rows[0][1], None, "p")]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == plain(rows, 0.93)
    assert len(found) == len(rows)


def test_empty_table_null_and_repeated_ids(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, "")]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in found) == [("1", 1, True), ("1", 1, True), ("None", 0, True)]


def test_isolated_pairs_in_a_crowded_direction(spark, monkeypatch):
    monkeypatch.setattr("agora.llm.embeddings.CROWD", 64)
    monkeypatch.setattr("agora.llm.embeddings.SENDING", 16)
    rng = np.random.default_rng(11)

    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    own = unit(rng.standard_normal((3000, 64)))
    left = unit(0.9 * unit(rng.standard_normal((1, 64))) + 0.436 * own)
    aside = rng.standard_normal((3000, 64))
    aside = unit(aside - (aside * left).sum(axis=1, keepdims=True) * left)
    right = 0.935 * left + (1 - 0.935**2) ** 0.5 * aside
    rows = [(k, v.tolist(), 1, "p") for k, v in enumerate(np.concatenate((left, right)).astype(np.float32))]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    component = {r.vec_id: r.component_id for r in found}
    assert [k for k in range(3000) if component[k] != component[k + 3000]] == []


@pytest.mark.parametrize("bits", [1, 5, 13, 32])
def test_passes_keep_the_bound(bits):
    from agora.llm.embeddings import MISS, passes_for

    meet = (1 - np.arccos(0.93) / np.pi) ** bits
    assert (1 - meet) ** passes_for(bits) <= MISS < (1 - meet) ** (passes_for(bits) - 1)
    assert passes_for(0) == 1


def test_given_vectors_go_through_several_sorted_passes(spark):
    from agora.llm.embeddings import SIMILARITY, WINDOW, _ordered, _plans, near_vectors

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    points = vectors.selectExpr("cast(label as long) label", "size(embedding) dims", "vec_id point", "embedding")
    plans = _plans(points, SIMILARITY, 1e-4, 7)
    assert all(p.bits > 0 and p.passes > 1 and p.n > WINDOW for p in plans.collect())
    sent = _ordered(points, plans, 7, "float")
    assert sent.count() == plans.selectExpr("sum(n * passes)").first()[0]
    longest = sent.groupBy("pass", "label", "start").count().agg({"count": "max"}).first()[0]
    assert longest < plans.agg({"n": "min"}).first()[0]
    found = near_vectors(vectors).collect()
    rows = [(r.vec_id, r.embedding, r.label, "") for r in vectors.collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == plain(rows, SIMILARITY)


def test_neighbours_past_a_beginning_are_compared_across_batches():
    from agora.llm.embeddings import _window_links

    turn = np.linspace(0, np.pi, 9000)
    vectors = np.stack((np.cos(turn), np.sin(turn)), axis=1)
    n = len(turn)
    whole = pa.RecordBatch.from_pydict(
        {
            "pass": np.zeros(n, np.int32),
            "label": np.zeros(n, np.int64),
            "dims": np.full(n, 2, np.int32),
            "region": np.zeros(n, np.int64),
            "one": np.zeros(n, np.int32),
            "two": np.zeros(n, np.int32),
            "own": np.zeros(n, np.int32),
            "start": np.arange(n) // 10,
            "point": np.arange(n),
            "embedding": vectors.tolist(),
        }
    )
    batches = [whole.slice(at, 500) for at in range(0, n, 500)]
    edges = pa.Table.from_batches(_window_links(0.93, 3)(iter(batches)))
    parent = dict(zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True))
    assert len(parent) >= n - 1 - 3 and set(parent) | {0} == set(range(n))
