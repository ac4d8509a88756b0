import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import gru, language, quality, toxicity
from agora.llm.boosting import fit
from agora.llm.labelled import held_out, sample

SF = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = gru.fresh(["a", "b", "c"], 4, 1)
    for name in ("table", "within", "out", "bias"):
        value = getattr(net, name).astype(np.float64)
        setattr(net, name, value + 0.1 * rng.standard_normal(value.shape))
    codes = rng.integers(0, 256, (3, 5, 4)).astype(np.int16)
    codes[1, 3:], codes[2, 2, 2:], codes[2, 3:] = gru.PAD, gru.PAD, gru.PAD
    truth = np.array([0, 2, 1])
    _, grads = gru.gradients(net, codes, truth)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            k = np.unravel_index(at, p.shape)
            was, sides = p[k], []
            for step in (1e-5, -1e-5):
                p[k] = was + step
                sides.append(gru.gradients(net, codes, truth)[0])
            p[k] = was
            assert abs((sides[0] - sides[1]) / 2e-5 - g[k]) < 1e-6


def test_windows_cover_whole_texts():
    codes = gru.windows(b"abcdefghi" * 30, 8)
    assert bytes(int(c) for c in codes.ravel() if c != gru.PAD) == b"abcdefghi" * 30
    net = gru.fresh(["a", "b"], 3, 1)
    probs = gru.pooled(net, [b"xy" * 100, b"", b"q"], 8, 3)
    assert np.allclose(probs.sum(axis=1), [1, 0, 1], atol=1e-5)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.fit_language(docs)
    rows = language.predict(docs.where(held_out("doc_id", 3, 1)), net, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "é"), (4, "é")], "score long, text string")
    found = language.predict(odd.select(F.col("score").alias("id"), "text"), net, ["id"]).collect()
    assert [r.lang_pred == "und" for r in sorted(found, key=lambda r: r.id)] == [True, True, True, False, False]
    assert all(0 <= r.score <= 1 for r in rows + found)
    empty = docs.limit(0)
    assert language.fit_language(empty) is None and language.predict(empty, net, ["doc_id"]).count() == 0


@pytest.mark.parametrize(("label", "parts", "part", "folder"), [("quality", 5, 0, SF), ("toxic", 3, 1, "/root/testdata/sf0.1")])
def test_scores_of_held_out_documents(spark, label, parts, part, folder):
    # The toxic terms of four languages need more than the 30 examples of the smallest data.
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = sample(docs, labels, label, parts, part, 10_000)
    known = {r.doc_id: r[label] for r in labels.collect()}
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % parts != part for i in known)
    assert sample(docs, labels, label, parts, part, 50) == sample(docs.repartition(5), labels.repartition(3), label, parts, part, 50)
    if label == "quality":
        model = quality.fit_quality(rows)
        found = quality.score(docs, model)
        odd = quality.score
    else:
        model = toxicity.fit_lexicon(rows)
        found = toxicity.score(docs, model)
        odd = toxicity.score
    pairs = [(r.score, known[r.doc_id]) for r in found.where(held_out("doc_id", parts, part)).collect() if r.doc_id in known]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.9
    strange = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x" * 200_000), (3, "12")], "doc_id long, text string")
    scores = odd(strange, model).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    assert odd(strange.limit(0), model).count() == 0


def test_trees_learn_and_hold_on_degenerate_input():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = fit(x[:400], y[:400])
    assert ((trees.score(x[400:]) > 0.5) == y[400:]).mean() > 0.93
    assert fit(np.zeros((0, 5)), np.zeros(0)).score(x).tolist() == [0.5] * 600
    assert fit(x, np.ones(600)).score(x).min() > 0.9
    assert len(quality.statistics("")) == len(quality.statistics("One two.\nThree"))


def test_folding_undoes_disguises():
    assert toxicity.fold("You 1d10t, stupіd $cum") == " you idiot stupid scum "
    assert toxicity.fold("") == "  " and toxicity.fold("trash### 42") == " trash "
    assert toxicity.fold("ＣＬＯＷＮ") == " clown "


def test_lexicon_learns_terms_and_exceptions():
    harmless = [f"a nice word number {k} {'and the blob fish swims' if k < 10 else 'is here'}" for k in range(60)]
    toxic = [f"such a {'blob' if k % 2 else 'bl0b'} you are, number {k}" for k in range(40)]
    lexicon = toxicity.fit_lexicon([(t, 0) for t in harmless] + [(t, 1) for t in toxic])
    matcher = lexicon.matcher()
    assert " blob " in lexicon.weights and " blob fish " in lexicon.exceptions
    assert matcher.score("what a BL0B") > matcher.score("the blob fish swims") and matcher.hits(toxicity.fold("a blob fish")) == []
    assert toxicity.Lexicon({}).matcher().score("anything") < 0.1
    assert toxicity.fit_lexicon([]).weights == {}


def test_a_repeated_id_and_long_texts_stay_within_the_bounds_of_a_sample(spark):
    from agora.llm.labelled import bounded

    many = spark.range(100_000, numPartitions=4).selectExpr("7L AS id", "concat('text ', id) AS text", "cast(id % 2 AS int) AS label")
    few = spark.createDataFrame([(1, "x" * 900, 0), (2, "y" * 500, 1), (3, "z" * 100, 0), (4, "", 1)], "id long, text string, label int")
    found = bounded(many.unionByName(few))
    assert [r.id for r in found] == [1, 2, 3, 4, 7] and found[-1].text == "text 0" and found[-1].label == 0
    assert bounded(few.unionByName(few)) == found[:4]
    tight = bounded(few, 600)
    assert sum(len(r.text) for r in tight) <= 600 and {3, 4} <= {r.id for r in tight}
    assert bounded(few.limit(0)) == []
    docs = many.select(F.col("id").alias("doc_id"), "text")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, None)], "doc_id long, toxic int")
    other = next(k for k in range(3) if zlib.crc32(b"7") % 3 != k)
    assert sample(docs, labels, "toxic", 3, other, 100) == [("text 0", 0)]
