import hashlib
import random

from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from agora.llm.bpe import vocabulary_path
from tests.llm.test_decontamination import plain as plain_hits
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import plain as plain_repeats

SF = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    rows = [r for r in documents.collect() if rng.random() < 0.25]
    rows += [(90_001, None, None, "s", 0), (90_002, "12 34", "en", "s", 5), (90_003, rows[0].text, "en", "s", 1)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.createDataFrame(rows, documents.schema)
    kept = [corpus_pipeline.STAGES[0][1](spark, docs, SF)]
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept[0].collect()} == {90_001, 90_002}

    table = {r.doc_id: r.text for r in kept[0].collect()}
    ids = sorted(table)
    groups = plain_components(ids, [plain_fingerprint(table[i]) for i in ids])
    kept.append(corpus_pipeline.STAGES[1][1](spark, kept[0], SF))
    stay = sorted(r.doc_id for r in kept[1].collect())
    assert stay == sorted(set(groups))

    left = plain_repeats([(i, table[i]) for i in stay], 50)
    kept.append(corpus_pipeline.STAGES[2][1](spark, kept[1], SF))
    cut = {r.doc_id: r.text for r in kept[2].collect()}
    assert cut == {i: left[i][0].decode("utf-8", "ignore") for i in stay}

    hits = plain_hits(list(cut.items()), items)
    kept.append(corpus_pipeline.STAGES[3][1](spark, kept[2], SF))
    clean = {r.doc_id: r.text for r in kept[3].collect()}
    assert set(clean) == {i for i in cut if not hits[i][3]}
    assert all(k.columns == docs.columns for k in kept)

    library = Tokenizer.from_file(vocabulary_path())
    for r in corpus_pipeline.STAGES[4][1](spark, kept[3], SF).collect():
        tokens = library.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest()
        assert (r.n_tokens, r.decoded_sha256) == (len(tokens), hashlib.sha256(clean[r.doc_id].encode()).hexdigest())


def test_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_languages_of_any_number(spark):
    """Without a language nothing with letters goes; with one or six, clean documents stay."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in documents.collect() if r.text and len(r.text) > 200][:120]
    stage = corpus_pipeline.STAGES[0][1]
    odd = [(90_001, None, None, "s", 0), (90_002, "12 34", "en", "s", 5)]
    for languages in (0, 1, 6):
        own = [(r.doc_id, r.text, f"l{k % languages}" if languages else None, r.source, r.n_chars) for k, r in enumerate(rows)]
        left = stage(spark, spark.createDataFrame(own + odd, documents.schema), SF)
        stay = {r.doc_id for r in left.collect()}
        assert stay <= {r.doc_id for r in rows} and left.columns == documents.columns
        assert len(stay) == len(rows) if languages < 2 else len(stay) > 0
    assert corpus_pipeline.least_score(4) == 0.3 and corpus_pipeline.least_score(6) < 0.3


def test_columns_with_clashing_names(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    named = documents.withColumnsRenamed({"source": "row", "n_chars": "score"})
    left = corpus_pipeline.STAGES[0][1](spark, named, SF)
    assert left.columns == named.columns
    # Long texts come in several slices of a batch.
    long = spark.range(8).selectExpr("id + 70000 AS doc_id", "repeat('the cat and the hat. ', 40000) AS text", "'en' AS lang", "'s' AS row", "id AS score")
    named = named.unionByName(long).coalesce(1)
    left = corpus_pipeline.STAGES[0][1](spark, named, SF)
    same = {r.doc_id: tuple(r) for r in named.collect()}
    assert all(same[r.doc_id] == tuple(r) for r in left.collect())


def test_queries_are_registered():
    names = list(contract.queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 14)] and "pipeline" in names
    assert set(contract.oracle_sql()) <= set(names)
