"""SimHash near-duplicates: exact links of fingerprints by vantage-point trees.

Fingerprints of equal value meet first and stand for one point.  Two points that
differ in at most ``radius`` bits agree in at least ``equal`` of ``radius + equal``
bit blocks, so every point goes to the shard of each choice of ``equal`` blocks and
no pair is lost at a shard's edge.  In every shard, however small, a vantage-point
tree finds the pairs: each point is the vantage of one node, the others below it are
divided at their median Hamming distance from it, and a branch is left out when the
triangle inequality proves that nothing in it is near.  The trees of all shards of a
batch are built and searched together, level by level, in arrays.

Vantage distances alone cannot make the shards: random 64-bit fingerprints lie at
32 +- 4 bits from any point, so a cut at the median with a border of 4 bits would
send three quarters of the points to both sides.

A shard with more than ``split`` points is cut into parts by the points' hash;
each pair of parts is a task, so one crowded block value never meets in one place.
Tasks return a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import by_bytes, group_starts, in_groups, kept, texts_of
from agora.llm.components import Forest, components

SEED = 42
SHINGLE = 4
RADIUS = 4
BITS = 64
#: Visits of nodes that are held at a time.
VISITS = 1 << 19


def fingerprint(text: str, shingle: int = SHINGLE, chunk: int = 1 << 15) -> int:
    """The signed 64-bit fingerprint of a text; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n = len(starts)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    starts, ends = starts.tolist(), ends.tolist()
    for at in range(0, n, chunk):
        part = zip(starts[at : at + chunk], ends[at : at + chunk], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        prints = [fingerprint(t) for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for every row of ``docs``; a null or empty text has fingerprint zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp long")


class VantageTrees:
    """A vantage-point tree for each run of ``points`` that begins at one of ``starts``.

    Node k below the number of runs is the root of run k.  A node knows its vantage,
    its two children (-1: none), and the least and largest distance from the vantage
    in each child.  ``visits`` counts the nodes that searches have come to.
    """

    def __init__(self, points: np.ndarray, starts: np.ndarray) -> None:
        n = len(points)
        self.points, self.starts, self.visits = points, starts, 0
        self.vantage = np.zeros(n, dtype=np.int32)
        self.child = np.full((n, 2), -1, dtype=np.int32)
        self.least = np.zeros((n, 2), dtype=np.int16)
        self.most = np.zeros((n, 2), dtype=np.int16)
        members, heads, done = np.arange(n, dtype=np.int32), starts, 0
        while len(heads):
            level = slice(done, done + len(heads))
            done += len(heads)
            others = np.diff(np.append(heads, len(members))) - 1
            self.vantage[level] = members[heads]
            members = np.delete(members, heads)
            owner = np.repeat(np.arange(len(heads)), others)
            far = np.bitwise_count(points[members] ^ points[self.vantage[level]][owner])
            order = np.lexsort((far, owner))
            members, far = members[order], far[order]
            ends = np.cumsum(others)
            middle = ends - others // 2
            cuts, stops = np.stack((ends - others, middle), axis=1), np.stack((middle, ends), axis=1)
            there = stops > cuts
            self.child[level][there] = done + np.arange(there.sum())
            self.least[level][there] = far[cuts[there]]
            self.most[level][there] = far[stops[there] - 1]
            heads = cuts[there]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Position arrays (i, j), i < j, of all points of one run at most ``radius`` bits apart."""
        sizes = np.diff(np.append(self.starts, len(self.points)))
        todo = [(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.arange(len(self.points), dtype=np.int32))]
        while todo:
            node, query = todo.pop()
            if len(node) > VISITS:
                half = len(node) // 2
                todo += [(node[half:], query[half:]), (node[:half], query[:half])]
                continue
            self.visits += len(node)
            vantage = self.vantage[node]
            away = np.bitwise_count(self.points[query] ^ self.points[vantage]).astype(np.int16)
            near = (away <= radius) & (query < vantage)
            yield query[near], vantage[near]
            below = []
            for side in (0, 1):
                child = self.child[node, side]
                goes = (child >= 0) & (away >= self.least[node, side] - radius) & (away <= self.most[node, side] + radius)
                below.append((child[goes], query[goes]))
            node, query = (np.concatenate(c) for c in zip(*below, strict=True))
            if len(node):
                todo.append((node, query))


def vantage_pairs(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position arrays (i, j), i < j, of all points at most ``radius`` bits apart."""
    return VantageTrees(points, np.zeros(min(1, len(points)), dtype=np.int64)).pairs(radius)


def _shards(points: DataFrame, radius: int, equal: int) -> DataFrame:
    """(choice, value, fp): each point under every choice of ``equal`` bit blocks."""
    count = radius + equal
    edges = [BITS * k // count for k in range(count + 1)]
    masks = []
    for chosen in combinations(range(count), equal):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(masks)])
    return points.select("fp", F.explode(keys).alias("key")).select("key.choice", "key.value", "fp")


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_groups(batches, ["choice", "value", "one", "two"]):
            points = rows.column("fp").to_numpy()
            trees = VantageTrees(points.view(np.uint64), group_starts(rows, ["choice", "value", "one", "two"]))
            forest = Forest(len(points))
            for i, j in trees.pairs(radius):
                forest.link(i, j)
            root = forest.roots()
            hung = np.flatnonzero(root != np.arange(len(points)))
            if len(hung):
                yield pa.RecordBatch.from_arrays([pa.array(points[hung]), pa.array(points[root[hung]])], ["a", "b"])

    return run


def near_points(points: DataFrame, rows: int, radius: int = RADIUS, split: int = 2048) -> DataFrame:
    """A spanning forest (a, b) of the links among the distinct fingerprints ``fp``.

    ``equal`` grows with the number of points so that shards stay small: 13 bits
    are shared up to some 30 million points, 21 bits up to some 8 billion.
    """
    equal = 1
    while equal < 4 and rows > (1 << (BITS * equal // (radius + equal))) * 4096:
        equal += 1
    shards = _shards(points, radius, equal)
    crowded = (
        shards.groupBy("choice", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > split)
        .select("choice", "value", F.ceil(F.col("n") / F.lit(split)).cast("int").alias("parts"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = (
        shards.join(crowded, ["choice", "value"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("choice", "value", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fp")
    )
    keys = ["choice", "value", "one", "two"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_forests(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, group, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id whose fingerprint is reachable over links
    of at most ``radius`` differing bits; ``group`` is that component's smallest
    fingerprint.  Null and empty texts share fingerprint
    zero and link like any other.  Rows with equal ids are kept as they are; a
    null id is kept and never chosen while its component has another.
    """
    prints = kept(fingerprints(docs, id_col, text_col)).frame
    points = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(near_points(points.frame.select("fp"), points.rows, radius))
    linked = found.join(points.frame.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    member = found.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    known = points.frame.join(member, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("group"), F.coalesce("component_id", "first").alias("component_id")
    )
    return prints.join(known, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
