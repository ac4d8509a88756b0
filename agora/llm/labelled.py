"""Bounded samples of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from agora.llm.common import kept

#: The most bytes of text that a sample brings to the driver.
SAMPLE_BYTES = 64 << 20


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether nothing may be learned from a row; a row without id is neither learned from nor held out."""
    return F.coalesce(remainder(id_col, parts) == part, F.lit(False))


def bounded(rows: DataFrame, most_bytes: int = SAMPLE_BYTES) -> list[Row]:
    """One (id, text, label) for each id of ``rows``, ``most_bytes`` of text at most, by id.

    An id that many rows have counts with its smallest text and label, found before
    anything is shuffled.  Beyond the bound a text is passed over if it no longer fits, in
    the order of a hash of the ids.  ``rows`` must have a bounded number of ids.
    """
    one = kept(rows.groupBy("id").agg(F.min(F.struct("text", "label")).alias("one")).select("id", "one.text", "one.label")).frame
    sizes = one.select("id", F.octet_length("text").alias("size"), F.xxhash64("id").alias("place")).collect()
    left, fits = most_bytes, []
    for row in sorted(sizes, key=lambda r: (r["place"], r["id"])):
        if row["size"] <= left:
            fits.append((row["id"],))
            left -= row["size"]
    if len(fits) < len(sizes):
        wanted = one.sparkSession.createDataFrame(fits, one.select("id").schema)
        one = one.join(F.broadcast(wanted), "id", "left_semi")
    return sorted(one.collect(), key=lambda r: r["id"])


def sample(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES
) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` labelled ids outside fold ``part``, in a fixed order.

    Which ids is settled by a hash of them; ``bounded`` says which of their texts.  Both
    bounds are what reaches the driver; the size of the corpus does not matter.
    """
    allowed = labels.where(F.col(label).isin(0, 1) & (remainder(id_col, parts) != part)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    chosen = allowed.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return [(r["text"], r["label"]) for r in bounded(texts.join(F.broadcast(chosen), "id"), most_bytes)]
