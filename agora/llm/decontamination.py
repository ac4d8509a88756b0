"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of a benchmark item, or all words of a shorter
item.  Documents are scanned at every tenth word only: a 13-word window that
starts anywhere holds four words that start at a multiple of ten, so a document
position whose four words occur in no item (a broadcast set of hashes) starts no
window nearby.  What is left is compared word for word with the windows.

Long documents are first cut into blocks of words, so that no row carries more
than a block while positions are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import fresh_name, kept, table

WINDOW = 13
SEED_WORDS = 4
BLOCK = 2000
# Windows and seeds are broadcast while they are no more than this; a window is
# the only text among them and holds 13 words.
BROADCAST_WINDOWS = 200_000
# The characters that separate words, by code point.
NOT_A_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
# The same in a text that still has its capitals.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"[^{NOT_A_WORD}]+"), F.lit(0))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, window): the distinct windows of every item, as words joined by spaces."""
    words = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    words = words.withColumn("length", F.least(F.size("words"), F.lit(WINDOW))).where("length > 0")
    at = words.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    window = F.array_join(F.slice("words", F.col("start"), F.col("length")), " ")
    return at.select("item_id", "length", window.alias("window")).distinct()


def _seed(words: Column, first: Column, count: int) -> Column:
    return F.xxhash64(*[F.get(words, first + k) for k in range(count)])


def _seeds(windows: DataFrame, length: int, count: int) -> DataFrame:
    words = windows.where(F.col("length") == length).select(F.split("window", " ").alias("words"))
    at = words.select("words", F.explode(F.sequence(F.lit(0), F.lit(length - count))).alias("at"))
    return at.select(_seed(F.col("words"), F.col("at"), count).alias("seed")).distinct()


def _places(docs: DataFrame, length: int) -> DataFrame:
    """Rows (key, n_words, at, lead, near, seed): the words around each scanned position.

    One more row per document, with null ``at``, keeps documents without any.
    """
    count = min(SEED_WORDS, length)
    step = length - count + 1
    block = BLOCK // step * step
    last = F.col("n_words") - count
    starts = F.when(F.col("n_words") >= length, F.sequence(F.lit(0), last, F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = F.concat(
        F.array(F.struct(F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("array<string>").alias("part"))),
        F.transform(
            starts,
            lambda b: F.struct(
                b.alias("from"),
                F.greatest(b - (step - 1), F.lit(0)).alias("low"),
                F.slice("words", F.greatest(b - (step - 1), F.lit(0)) + 1, F.lit(block + length + step)).alias("part"),
            ),
        ),
    )
    cut = docs.select("key", "n_words", F.explode(blocks).alias("b")).select("key", "n_words", "b.*")
    places = F.when(F.col("from").isNull(), F.array(F.lit(None).cast("int"))).otherwise(
        F.sequence(F.col("from"), F.least(F.col("from") + (block - step), F.greatest("from", F.col("n_words") - count)), F.lit(step))
    )
    near = F.transform(
        places,
        lambda j: F.struct(
            j.alias("at"),
            F.least(j, F.lit(step - 1)).alias("lead"),
            F.slice("part", F.greatest(j - (step - 1), F.lit(0)) - F.col("low") + 1, F.least(j, F.lit(step - 1)) + length).alias("near"),
        ),
    )
    rows = cut.select("key", "n_words", F.explode(near).alias("p")).select("key", "n_words", "p.*")
    return rows.withColumn("seed", _seed(F.col("near"), F.col("lead"), count))


def _hits(docs: DataFrame, windows: DataFrame, few: bool, length: int) -> DataFrame:
    """(key, n_words, start, item_id) of every window occurrence; one row with null start per document."""
    hinted = F.broadcast if few else (lambda frame: frame)
    count = min(SEED_WORDS, length)
    seeds = _seeds(windows, length, count).withColumn("known", F.lit(True))
    places = _places(docs, length).join(hinted(seeds), "seed", "left").where("at is null or known")
    starts = F.when(F.col("at").isNull(), F.array(F.lit(None).cast("int"))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("lead")), lambda k: k + length <= F.size("near"))
    )
    found = places.withColumn("skip", F.explode(starts)).select(
        "key",
        "n_words",
        (F.col("at") - F.col("lead") + F.col("skip")).alias("start"),
        F.array_join(F.slice("near", F.col("skip") + 1, F.lit(length)), " ").alias("window"),
    )
    wanted = windows.where(F.col("length") == length).select("window", "item_id", F.lit(True).alias("hit"))
    return found.join(hinted(wanted), "window", "left").where("start is null or hit").select("key", "n_words", "start", F.lit(length).alias("length"), "item_id")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: (doc_id, text_hash, n_words, spans, items, n_hit).

    ``spans`` are the (start, length) of all window occurrences in words, in order;
    ``items`` the ids of the items they belong to, as strings in order; ``n_hit``
    counts the words inside any occurrence.  A null or empty text has no words and
    no spans.  An item without words has no windows; an item with a null id makes
    spans but is not listed.  Rows with equal id and text are one document here and
    get the same result when joined back.  With an empty benchmark nothing is hit.
    """
    windows = kept(item_windows(benchmark, item_col, item_text_col))
    few = windows.rows <= BROADCAST_WINDOWS
    lengths = sorted(r[0] for r in windows.frame.select("length").distinct().collect())  # at most 13 numbers
    words = words_of(F.col(text_col))
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash")).alias("key"), words.alias("words"))
    rows = rows.withColumn("n_words", F.size("words"))
    hits = None
    for length in lengths or [WINDOW]:
        found = _hits(rows, windows.frame, few, length)
        hits = found if hits is None else hits.unionByName(found)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "length"))
    per_doc = hits.groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda done, s: F.struct(
            (done["sum"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], done["end"]))).alias("sum"),
            F.greatest(done["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda done: done["sum"],
    )
    return per_doc.select("key.doc_id", "key.text_hash", "n_words", "spans", "items", covered.alias("n_hit"))


def is_contaminated() -> Column:
    """The rule: some word is hit, and hits are at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit").cast("long") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or with hit words cut out (mode "spans").

    "spans" cuts each hit word together with the separators before it, in every
    document.  All columns are kept; other rows pass unchanged, nulls and repeated
    rows included.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    found = contamination(docs, benchmark, id_col, text_col)
    hit = found.where(is_contaminated() if mode == "documents" else F.col("n_hit") > 0)
    names = {n: fresh_name(f"hit_{n}", docs.columns) for n in ("doc_id", "text_hash", "spans")}
    hit = hit.select(*[F.col(n).alias(to) for n, to in names.items()])
    same = docs[id_col].eqNullSafe(hit[names["doc_id"]]) & (F.xxhash64(docs[text_col]) == hit[names["text_hash"]])
    if mode == "documents":
        return docs.join(hit, same, "left_anti")
    word = f"[{BETWEEN}]*[^{BETWEEN}]+"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(word), F.lit(0))
    spans = F.col(names["spans"])
    left = F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["start"] + s["length"])))
    rest = F.regexp_extract(F.col(text_col), f"[{BETWEEN}]*\\z", 0)
    cut = F.when(spans.isNotNull(), F.concat(F.array_join(left, ""), rest)).otherwise(F.col(text_col))
    return docs.join(hit, same, "left").withColumn(text_col, cut).select(*docs.columns)


def for_each_row(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``contamination``, as often as ``docs`` has a row of that id and text.

    Rows are counted for each partition, so a row that is repeated very often comes
    from many tasks and is never one long array.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.spark_partition_id().alias("part"))
    counts = rows.groupBy("id", "hash", "part").agg(F.count(F.lit(1)).alias("n"))
    same = found["doc_id"].eqNullSafe(counts["id"]) & (found["text_hash"] == counts["hash"])
    joined = counts.join(found, same)
    return joined.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*found.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = for_each_row(contamination(docs, table(spark, sf_dir, "benchmark")), docs)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
