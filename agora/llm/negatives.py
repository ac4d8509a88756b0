"""Hard negatives by best-first search in sort-tile-recursive packed R-trees.

Vectors become whole numbers, floor(scale * x), so inner products are exact.  All rows
are dealt by ranges of (label, length, first components, id); inside a task they are cut
into tiles along the components that vary most, and each tile of ``LEAF`` rows becomes a
leaf with its minimum bounding box.  The leaves are one written table, the index.

A box bounds the inner product of a query with every vector inside it, component by
component.  A search takes boxes from a queue, the one with the highest bound first.  It
prunes boxes that lie outside all open score windows, and those whose bound is strictly
below the kth best score so far; an equal bound is opened, since a smaller id wins a tie.

The queries are a stated set.  They come in blocks of ``BLOCK`` rows at most, and each
block is broadcast and searched in every part of the index: once for the positives,
which set the score windows, and once for the negatives.  The best of all parts are
merged by a window, so no group is ever gathered.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.llm.common import by_bytes, kept, table

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative scores between these shares, in hundredths, of the positive's score.
LOW, HIGH = 80, 100
LEAF = 128
FAN = 16
#: Rows that are tiled together, and leaves that one tree holds.
CHUNK = 1 << 16
TREE = 512
#: Queries per block; a block is also cut to this many bytes of components.
BLOCK = 1 << 14
BLOCK_BYTES = 1 << 23
_EXACT = 1 << 53

_INDEX = "label long, dims int, ids binary, vectors binary, low binary, high binary"


def whole_vectors(rows: DataFrame, id_col: str, label: Column, embedding_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, dims, vector) of the rows that take part, components as whole numbers.

    Rows without id, label or vector, with a null or non-finite component, or with one so
    large that an inner product could leave the range of a long, take no part.
    """
    raw = F.col(embedding_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), raw.alias("raw"))
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("raw"), F.lit(1))) / scale - 1
    sound = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & sound)
    return rows.select("id", "label", F.size("raw").alias("dims"), F.transform("raw", lambda x: F.floor(F.lit(scale) * x)).alias("vector"))


def tiles(vectors: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Positions of the rows in each leaf, sort-tile-recursive over the most varied components."""
    axes = np.argsort(-vectors.var(axis=0), kind="stable") if vectors.size else np.empty(0, dtype=int)

    def cut(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        pages = math.ceil(len(rows) / leaf)
        if pages <= 1 or depth >= len(axes):
            for at in range(0, len(rows), leaf):
                yield rows[at : at + leaf]
            return
        left = min(len(axes) - depth, max(1, math.ceil(math.log2(pages))))
        slabs = math.ceil(pages ** (1 / left))
        rows = rows[np.argsort(vectors[rows, axes[depth]], kind="stable")]
        size = leaf * math.ceil(pages / slabs)
        for at in range(0, len(rows), size):
            yield from cut(rows[at : at + size], depth + 1)

    yield from cut(np.arange(len(vectors)), 0)


def _packed(leaf: int, chunk: int):
    """Leaves of the sorted rows of a partition; a row that is there again is left out."""

    def leaves(label: int, dims: int, ids: list[int], vectors: list[bytes]) -> pa.RecordBatch:
        numbers = np.array(ids, dtype=np.int64)
        matrix = np.frombuffer(b"".join(vectors), dtype=np.int64).reshape(len(ids), dims)
        made = list(tiles(matrix, leaf))
        columns = [
            pa.array([label] * len(made), pa.int64()),
            pa.array([dims] * len(made), pa.int32()),
            pa.array([numbers[t].tobytes() for t in made], pa.binary()),
            pa.array([matrix[t].tobytes() for t in made], pa.binary()),
            pa.array([matrix[t].min(axis=0).tobytes() if dims else b"" for t in made], pa.binary()),
            pa.array([matrix[t].max(axis=0).tobytes() if dims else b"" for t in made], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["label", "dims", "ids", "vectors", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors = None, [], []
        key, seen = None, set()
        for batch in by_bytes(batches):
            flat, offsets = batch.column("vector").flatten().to_numpy(), batch.column("vector").offsets.to_numpy()
            offsets = offsets - offsets[0]
            labels, dims, numbers = (batch.column(c).to_pylist() for c in ("label", "dims", "id"))
            for k, now in enumerate(zip(labels, dims, strict=True)):
                vector = flat[offsets[k] : offsets[k + 1]].tobytes()
                # Rows with the same sorting key are neighbours, so a copy is seen at once.
                here = (now, vector[:16], numbers[k])
                if here != key:
                    key, seen = here, set()
                if vector in seen:
                    continue
                seen.add(vector)
                if group is not None and (now != group or len(ids) >= chunk):
                    yield leaves(*group, ids, vectors)
                    ids, vectors = [], []
                group = now
                ids.append(numbers[k])
                vectors.append(vector)
        if ids:
            yield leaves(*group, ids, vectors)

    return run


def pack(points: DataFrame, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """The index of ``points`` (id, label, dims, vector): one row per leaf.

    Ranges end inside a label, and inside a run of equal vectors, so that neither a
    frequent label nor a frequent vector makes a large partition.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("label"), F.col("dims"), F.get("vector", F.lit(0)), F.get("vector", F.lit(1)), F.col("id")]
    dealt = points.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_packed(leaf, chunk), _INDEX)


class Tree:
    """An R-tree over leaves of vectors of one length; every level has boxes and a range of labels."""

    def __init__(self, leaves: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], kind: type, fan: int = FAN) -> None:
        self.fan = fan
        self.ids = [leaf[1] for leaf in leaves]
        self.vectors = [leaf[2].astype(kind) for leaf in leaves]
        low, high = np.stack([leaf[3] for leaf in leaves]).astype(kind), np.stack([leaf[4] for leaf in leaves]).astype(kind)
        first = last = np.array([leaf[0] for leaf in leaves])
        self.levels = [(low, high, first, last)]
        while len(low) > 1:
            at = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((low, high, first, last))
        self.opened = 0

    def search(self, query: np.ndarray, label: int, same: bool, wanted: Windows) -> None:
        """Offer ``wanted`` the scores of the rows with (``same``) or without the label, leaf by leaf."""
        rising, falling = np.maximum(query, 0), np.minimum(query, 0)
        queue: list[tuple[float, int, int, float]] = []

        def push(level: int, start: int, stop: int) -> None:
            low, high, first, last = (a[start:stop] for a in self.levels[level])
            able = (first <= label) & (last >= label) if same else (first != label) | (last != label)
            most = high @ rising + low @ falling
            least = low @ rising + high @ falling
            for k in np.flatnonzero(able & wanted.open(least, most)):
                heapq.heappush(queue, (-most[k], level, start + int(k), least[k]))

        push(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue:
            most, level, node, least = heapq.heappop(queue)
            if -most < wanted.lowest:
                return
            if level:
                push(level - 1, node * self.fan, min((node + 1) * self.fan, len(self.levels[level - 1][0])))
            elif wanted.open_one(least, -most):
                self.opened += 1
                wanted.offer(self.vectors[node] @ query, self.ids[node])


class Windows:
    """The best ``k`` (score, id) within each of some score windows; higher scores first, then smaller ids."""

    def __init__(self, floors: list[int], caps: list[float], k: int, without: int | None = None) -> None:
        self.floors, self.caps, self.k, self.without = floors, caps, k, without
        #: A window's floor rises to its kth best score.
        self.bounds = list(floors)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in floors]
        self.lowest = min(floors, default=math.inf)
        self._sides()

    def _sides(self) -> None:
        self._bounds, self._caps = np.array(self.bounds, dtype=float), np.array(self.caps, dtype=float)

    def open(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return ((most[:, None] >= self._bounds) & (least[:, None] <= self._caps)).any(axis=1)

    def open_one(self, least: float, most: float) -> bool:
        return any(most >= b and least <= c for b, c in zip(self.bounds, self.caps, strict=True))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        near = scores >= self.lowest
        if self.without is not None:
            near &= ids != self.without
        if not near.any():
            return
        scores, ids = scores[near].astype(np.int64), ids[near]
        for w, (bound, cap) in enumerate(zip(self.bounds, self.caps, strict=True)):
            inside = (scores >= bound) & (scores <= cap)
            if not inside.any():
                continue
            s, i = np.concatenate([self.found[w][0], scores[inside]]), np.concatenate([self.found[w][1], ids[inside]])
            order = np.lexsort((i, -s))[: self.k]
            self.found[w] = s[order], i[order]
            if len(order) == self.k:
                self.bounds[w] = max(bound, int(s[order[-1]]))
        self.lowest = min(self.bounds)
        self._sides()


#: Below every score, above every score.
_NO_FLOOR, _NO_CAP = -(1 << 62) - 1, math.inf


def window_of(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the highest whole score s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _searched(block, make, same: bool, most_leaves: int):
    """(query, window, score, id): what the leaves of a partition add for each query of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[tuple[int, int, np.ndarray, object]] = block.value
        wanted = [make(q) for q in queries]
        held: dict[int, list[tuple]] = {}

        def search(dims: int) -> None:
            leaves = held.pop(dims)
            largest = max(max(int(np.abs(leaf[3]).max(initial=0)), int(np.abs(leaf[4]).max(initial=0))) for leaf in leaves)
            trees: dict[type, Tree] = {}
            for (_, label, vector, _), windows in zip(queries, wanted, strict=True):
                if len(vector) != dims or not windows.floors:
                    continue
                exact = max(1, dims) * largest * int(np.abs(vector).max(initial=0)) < _EXACT
                kind = np.float64 if exact else np.int64
                if kind not in trees:
                    trees[kind] = Tree(leaves, kind)
                trees[kind].search(vector.astype(kind), label, same, windows)

        for batch in by_bytes(batches):
            for row in batch.to_pylist():
                ids, dims = np.frombuffer(row["ids"], np.int64), row["dims"]
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dims)
                held.setdefault(dims, []).append((row["label"], ids, vectors, np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)))
                if len(held[dims]) >= most_leaves:
                    search(dims)
        for dims in list(held):
            search(dims)
        for at in range(0, len(wanted), 1024):
            rows = [(at + n, w, s, i) for n, windows in enumerate(wanted[at : at + 1024]) for w, (ss, ii) in enumerate(windows.found) for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "slot", "score", "id"])

    return run


def _best(index: DataFrame, block, make, same: bool, k: int, most_leaves: int) -> DataFrame:
    """The first ``k`` of each query and window over all parts of the index, with their rank."""
    found = index.mapInArrow(_searched(block, make, same, most_leaves), "query int, slot int, score long, id long")
    order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_blocks(anchors: DataFrame, most: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(id, label, vector) of all anchors, at most about ``most`` at a time, in a fixed order inside a block."""
    anchors = kept(anchors)
    blocks = max(1, math.ceil(anchors.rows / most))
    place = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks))
    for b in range(blocks if anchors.rows else 0):
        rows = anchors.frame.where(place == b).collect()
        yield sorted(((r["id"], r["label"], np.array(r["vector"], dtype=np.int64)) for r in rows), key=lambda r: (r[0], r[1], r[2].tolist()))


def hard_negatives(
    points: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    leaf: int = LEAF,
    tree: int = TREE,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``points`` are rows of ``whole_vectors``; those where ``anchors`` is true are the
    queries.  A row that is there again, equal in all columns, counts once; rows that
    share an id alone count on their own.  An anchor's positives are its ``positives``
    best other rows of its label, its negatives the ``negatives`` best rows of other
    labels within the score window of a positive.  Vectors of different length never
    meet.  An anchor without positives, or without negatives, has no rows.
    """
    spark = points.sparkSession
    index = kept(pack(points, leaf)).frame
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    results = []
    widest = max(1, points.where(anchors).agg(F.max("dims")).first()[0] or 1)
    for rows in _in_blocks(points.where(anchors).distinct(), max(1, min(block, BLOCK_BYTES // (8 * widest)))):
        asked = spark.sparkContext.broadcast([(i, label, vector, None) for i, label, vector in rows])
        found = _best(index, asked, lambda q: Windows([_NO_FLOOR], [_NO_CAP], positives, q[0]), True, positives, tree)
        best: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
            best.setdefault(r["query"], []).append((r["id"], r["score"]))
        asked.unpersist()
        paired = spark.sparkContext.broadcast([(i, label, vector, best.get(n, [])) for n, (i, label, vector) in enumerate(rows)])

        def windows(q: tuple) -> Windows:
            sides = [window_of(score, low, high) for _, score in q[3]]
            return Windows([f for f, _ in sides], [c for _, c in sides], negatives)

        mined = _best(index, paired, windows, False, negatives, tree)
        pairs = spark.createDataFrame([(n, w, rows[n][0], i, s) for n, own in best.items() for w, (i, s) in enumerate(own)], "query int, slot int, anchor_id long, positive_id long, positive_score long")
        named = mined.join(F.broadcast(pairs), ["query", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        results.append(kept(named).frame)
        paired.unpersist()
    return reduce(DataFrame.union, results) if results else spark.createDataFrame([], schema)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    points = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives(points, F.col("id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () AS anchor, vec_id, label, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT anchor, a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label,
         CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM a JOIN v ON len(a.e) = len(v.e)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s
  WHERE label = anchor_label AND vec_id <> anchor_id QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND s.label <> s.anchor_label
  AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
