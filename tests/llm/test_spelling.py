import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm.spelling import INSERTED, REPLACED, KdTree, codes_of, counted, counts_of, lower_letters, misspelt, op13_spelling, pairs, runs, spelling_variants

LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))


def edits(word):
    """All words one edit away."""
    cut = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    shorter = {a + b[1:] for a, b in cut if b}
    same = {a + c + b[1:] for a, b in cut if b for c in LETTERS}
    longer = {a + c + b for a, b in cut for c in LETTERS}
    return (shorter | same | longer) - {word}


def plain_words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    """Every word with all its edits looked up."""
    forms, out = {}, []
    for w, n in words.items():
        near = [e for e in edits(w) if e in words]
        best = min(near, key=lambda e: (-words[e], e), default=None)
        forms[w] = (len(near), best if near and words[best] >= 10 * n else None)
    for w, n in words.items():
        root = w
        while forms[root][1]:
            root = forms[root][1]
        out.append((w, forms[w][1], root, n, forms[w][0], words.get(forms[w][1])))
    return sorted(out)


def vocabulary(seed, n, letters="abcdé"):
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 11)))
        words[w] = rng.choice([2, 3, 30, 400, 5000])
        for e in rng.sample(sorted(edits(w)), 3):
            if len(e) >= 7:
                words[e] = rng.choice([2, 2, 5, 50])
    return words


def variants(spark, words, **sizes):
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = spelling_variants(frame, **sizes).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"shard": 40, "leaf": 3}), (3, {"shard": 15, "leaf": 1, "sample": 60})])
def test_matches_brute_force(spark, seed, sizes):
    words = vocabulary(seed, 400)
    want = plain_variants(words)
    assert sum(r[4] for r in want) > 500 and any(r[1] for r in want)
    assert variants(spark, words, **sizes) == want


def test_anagrams_of_one_word_are_parted(spark):
    """Words with the same letters have one vector; a shard of them is dealt in parts."""
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdefg", 7)): 2 for _ in range(300)}
    words |= {w[:3] + "x" + w[4:]: 50 for w in list(words)[:40]} | {w + "a": 3 for w in list(words)[:40]}
    assert variants(spark, words, shard=20, leaf=4) == plain_variants(words)


def test_chains_ties_and_lone_words(spark):
    words = {"aaaaaaa": 100_000, "aaaaaab": 5_000, "aaaaabb": 300, "aaaabbb": 20, "aaabbbb": 2, "zzzzzzz": 2, "zzzzzzy": 20, "zzzzzzx": 20, "éééééééé": 7}
    got = variants(spark, words)
    assert got == plain_variants(words)
    by_word = {r[0]: r for r in got}
    assert by_word["aaabbbb"][2] == "aaaaaaa" and by_word["zzzzzzz"][1] == "zzzzzzx" and by_word["éééééééé"][1:3] == (None, "éééééééé")


def test_no_words(spark):
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_very_long_words(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ab") for _ in range(60_000))
    words = {long: 2, long[:777] + long[778:]: 30, long[:5] + "é" + long[6:]: 4, long + "c": 3, "short" * 2: 2}
    got = variants(spark, words)
    by_word = {r[0]: r for r in got}
    assert by_word[long][4] == 3 and by_word[long][1] == long[:777] + long[778:] and by_word["shortshort"][4] == 0


@pytest.mark.parametrize("mode", [REPLACED, INSERTED])
def test_each_pair_once(mode):
    rng = random.Random(6)
    base = sorted({"".join(rng.choice("abÀ") for _ in range(7)) for _ in range(400)})
    seek = base if mode == REPLACED else sorted({w[:k] + w[k + 1 :] for w in base for k in (0, 3, 6)})
    none = np.full(len(seek), -1)
    got = [(seek[x], base[y]) for x, y in pairs(codes_of(base), codes_of(seek), mode, none, none, 4).T]
    near = {(a, b) for a in seek for b in edits(a) if b in set(base)}
    # Words of one length that differ in one letter: the one that comes first finds the other.
    want = near if mode == INSERTED else {(a, b) for a, b in near if a < b}
    assert len(got) == len(set(got)) and set(got) == want


def test_the_tree_prunes():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(4000)})
    counts = counts_of(codes_of(words))
    tree = KdTree(counts, 16)
    none = np.full(len(words), -1)
    seen = sum(len(rows) * len(tree.leaves[at]) for at, rows, _, _ in tree.reach(counts, REPLACED, none, none))
    assert seen < len(words) ** 2 / 10
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(words)))


def test_lower_case_of_ascii_alone(spark):
    rows = spark.createDataFrame([("ABCÉÀßz",), ("Hello",), ("ÿÞ×÷Q",)], "w string").select(lower_letters(F.col("w")).alias("w")).collect()
    assert [r.w for r in rows] == ["abcÉÀßz", "hello", "ÿÞ×÷q"]


def test_from_texts(spark, docs):
    rng = random.Random(8)
    words = ["thinking", "Thinking", "thinkin", "différent", "DIFFÉRENT", "short", "aaaaaaaa", "x×y÷zÀÿ"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(40)) + ". KKelvin İstanbul") for k in range(60)]
    rows += [(900, None), (901, ""), (None, "thinking différent"), (902, "a" * 5000), (902, "a" * 5000), (3, rows[3][1])]
    want = plain_words(rows)
    table = docs(rows).withColumn("word", F.lit("own")).withColumn("n", F.lit("own"))
    got = counted(misspelt(runs(table)))
    assert {r.word: r.n for r in got.collect()} == want
    found = spelling_variants(got).select("word", "form", "root", "n", "n_near", "form_n")
    short = {w: n for w, n in want.items() if len(w) < 1000}
    assert sorted(tuple(r) for r in found.collect() if len(r.word) < 1000) == plain_variants(short)
    assert counted(misspelt(runs(table.limit(0)))).count() == 0


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = op13_spelling(spark, sf)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[0]) == plain_variants(plain_words(rows))
