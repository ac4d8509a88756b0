"""Quality scores of documents: boosted trees over statistics of the whole text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.boosting import Trees, fit
from agora.llm.common import by_bytes, table, texts_of
from agora.llm.labelled import held_out, sample

TRAIN_ROWS = 20_000
PARTS, PART = 5, 0
THRESHOLD = 0.3
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~", dtype=np.uint8)
_ENDS = (".", "!", "?", '"', "”", "…")
_plain = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?]?").fullmatch


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; defined for empty texts too."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    bytes_ = max(1, len(data))
    counts = np.bincount(data, minlength=256)
    words = text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = [s for s in text.split("\n") if s]
    m = max(1, len(lines))
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    kinds = len(seen)
    share = counts[counts > 0] / bytes_
    ends = sum(map(text.count, (". ", "! ", "? ", ".\n", "!\n", "?\n"))) + 1
    repeated = m - len(set(lines))
    odd = sum(c for w, c in seen.items() if not _plain(w))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        float(sizes.mean()),
        float(sizes.std()),
        float((sizes > 12).mean()),
        float((sizes <= 3).mean()),
        counts[48:58].sum() / bytes_,
        counts[65:91].sum() / bytes_,
        counts[97:123].sum() / bytes_,
        counts[128:].sum() / bytes_,
        counts[_SYMBOLS].sum() / bytes_,
        counts[124] / n,
        (counts[33:48].sum() + counts[58:65].sum()) / bytes_,
        (counts[32] + counts[9]) / bytes_,
        len(words) / m,
        sum(s.endswith(_ENDS) for s in lines) / m,
        repeated / m,
        kinds / n,
        max(seen.values(), default=0) / n,
        sum(c for _, c in seen.most_common(5)) / n,
        pairs / max(1, len(words) - 1),
        odd / n,
        float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
        len(words) / ends,
        sum(w[0].isupper() for w in words) / n,
        kinds / np.sqrt(n),
    ]


def fit_quality(rows: list[tuple[str, int]]) -> Trees:
    features = np.array([statistics(t) for t, _ in rows]).reshape(len(rows), -1)
    return fit(features, np.array([y for _, y in rows], dtype=float))


def _scores(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            features = np.array([statistics(t) for t in texts_of(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null counts as empty, repeated rows are kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(sample(docs, labels, "quality", PARTS, PART, TRAIN_ROWS))
    return score(docs, model).select(
        "doc_id", held_out("doc_id", PARTS, PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
