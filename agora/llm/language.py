"""Language of documents by a recurrent network over the bytes of the whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import by_bytes, release, table, texts_of
from agora.llm.gru import Gru, pooled, train
from agora.llm.labelled import SAMPLE_BYTES, bounded, held_out, remainder

TRAIN_ROWS = 2_000
PARTS, PART = 3, 1
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]").search


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS, most_bytes: int = SAMPLE_BYTES
) -> Gru | None:
    """Train on at most ``most`` documents outside the held-out fold, chosen by a hash of their id.

    Only that sample reaches the driver, one text for each id and ``most_bytes`` at
    most.  Documents without a language or a text teach nothing; without any others there
    is no network.
    """
    able = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col, PARTS) != PART))
    ids = able.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    rows = able.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).join(F.broadcast(ids), "id")
    return train([(r["text"].encode("utf-8", "surrogatepass"), r["label"]) for r in bounded(rows, most_bytes)])


def _predict(net: Gru | None, first: int = 1):
    """The columns from ``first`` on with the language and score of the text in the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in by_bytes(batches, 1 << 20):
            texts = texts_of(batch.column(0))
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            able = [k for k, t in enumerate(texts) if net is not None and _letter(t)]
            if able:
                means = pooled(net, [texts[k].encode("utf-8", "surrogatepass") for k in able])
                best = means.argmax(axis=1)
                for k, b, p in zip(able, best, means[np.arange(len(able)), best], strict=True):
                    langs[k], scores[k] = net.labels[b], min(1.0, float(p))
            names = [*batch.schema.names[first:], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(langs), pa.array(scores)], names)

    return run


def predict(docs: DataFrame, net: Gru | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with (lang_pred, score) of every whole text.

    A text that is null or has no letter is "und" with score 0, as is every text
    when there is no network.  Repeated rows are kept.
    """
    rows = docs.select(F.col(text_col).alias("_predicted_text"), *keep)
    schema = rows.drop("_predicted_text").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_predict(net), schema)


def with_language(docs: DataFrame, net: Gru | None, text_col: str = "text") -> DataFrame:
    """(text, row, lang_pred, score) of every row; ``row`` holds its other columns, so the text is sent once."""
    others = F.struct(*[c for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(F.col(text_col).alias("text"), others)
    schema = rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_predict(net, 0), schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit_language(docs), ["doc_id"]).select("doc_id", held_out("doc_id", PARTS, PART).alias("held_out"), "lang_pred", "score")
