import random
import re

import duckdb
import pytest

from agora.llm import decontamination
from agora.llm.decontamination import contamination, decontaminate, is_contaminated

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items):
    out = {}
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for item, item_text in items:
            iw = words(item_text)
            n = min(13, len(iw))
            windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        out[doc_id] = (len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.fixture
def case(spark, docs):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "ß", "日本"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    items = [(1, " ".join(passage)), (10, "Short Item here"), (2, "w1 w2 w1 w2 " * 5), (3, None), (4, "!!"), (5, "lone"), (6, " ".join(passage))]
    rows = [(0, None), (1, ""), (2, "..."), (3, "LONE"), (4, "a short-item HERE, b")]
    for k in range(5, 60):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([5, 13, 60, 400]))]
        at = rng.randrange(len(body) + 1)
        if k % 2:
            body[at:at] = passage[rng.randrange(10) : rng.randrange(15, 31)]
        rows.append((k, rng.choice([" ", ", ", "-"]).join(body)))
    return rows, items, docs(rows), spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("block", [2000, 40])
def test_hits_match_brute_force(case, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    rows, items, docs, benchmark = case
    found = contamination(docs, benchmark).withColumn("bad", is_contaminated()).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.bad) for r in found} == plain(rows, items)


def test_a_large_benchmark_is_not_broadcast(case, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    rows, items, docs, benchmark = case
    found = contamination(docs, benchmark).withColumn("bad", is_contaminated()).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.bad) for r in found} == plain(rows, items)


def test_documents_or_spans_go(case):
    rows, items, docs, benchmark = case
    want = plain(rows, items)
    left = decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows if not want[i][3]}
    cut = {r.doc_id: r.text for r in decontaminate(docs, benchmark, "spans").collect()}
    assert all(len(words(cut[i])) == want[i][0] - want[i][1] for i, _ in rows)
    assert all(cut[i] == t for i, t in rows if not want[i][1])
    with pytest.raises(ValueError):
        decontaminate(docs, benchmark, "lines")


def test_empty_tables_and_repeated_rows(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(7, " ".join("abcdefghijklm"))], ITEMS)
    rows = [(1, "x " + " ".join("abcdefghijklm")), (1, "x " + " ".join("abcdefghijklm")), (None, "y"), (1, "other text")]
    assert contamination(docs([]), one).count() == 0
    assert decontaminate(docs(rows), none).count() == 4
    assert sorted(r.text for r in decontaminate(docs(rows), one).collect()) == ["other text", "y"]


def test_repeated_rows_all_come_back(case, spark, docs, tmp_path):
    rows, items, _, benchmark = case
    rows = rows + [rows[7], rows[7], rows[4], rows[0]]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        want = db.execute(decontamination.OP6_SQL).fetchall()
    assert len(want) == len(rows)
    assert sorted(tuple(r) for r in decontamination.op6_decontamination(spark, str(tmp_path)).collect()) == sorted(want)
    nulls = docs([(None, "lone"), (None, "lone"), (None, None)])
    found = decontamination.for_each_row(contamination(nulls, benchmark), nulls).collect()
    assert sorted((r.n_words, r.n_hit) for r in found) == [(0, 0), (1, 1), (1, 1)]
