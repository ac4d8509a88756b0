"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets a string of random hashes, its signs at 32 random
hyperplanes, and the vectors of a label are put in the lexicographic order of these
strings.  A vector is compared, in double precision, with its next ``WINDOW``
neighbours and with all that agree with it in the first ``bits`` hashes: equal
beginnings are neighbours in the order, so the window only grows where it must.
Pairs that reach the similarity are united across passes into components.

Two vectors at angle t agree at a hyperplane with probability 1 - t/pi, whatever the
other vectors are.  So a pair at the least similarity shares no beginning in any of
``passes`` passes with probability (1 - (1 - t/pi)^bits)^passes, and closer pairs with
less; fixed windows alone would have no such bound.  The passes are derived from the
bits so that this stays at ``MISS`` or below.  The bits of a label are as many as make
its runs of equal beginnings as long as a window, and in a large label those of the
least cost, from its count and a pilot of the crowding of its vectors.

Tasks hold regions of the order, runs of neighbouring beginnings that no range cut
divides.  A beginning that very many vectors share is dealt in parts, every pair of
which meets in one task.

Then every component is compared whole, block against block, which gives the exact
number of links of each vector without listing pairs.  Equal vectors of a label are
one point with a weight from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from agora.llm.common import group_starts, in_groups, kept, table
from agora.llm.components import Forest, components

SIMILARITY = 0.93
#: The probability that all passes miss a pair at the least similarity.
MISS = 1e-4
#: The hashes that order the vectors; at most so many are a beginning that must be compared whole.
HASHES = 32
#: The neighbours every vector is compared with; a label of no more is one window.
WINDOW = 32
#: A region is so many of the first hashes shorter than a beginning.
REGION = 2
#: A beginning of more points is compared in parts; a label of more is planned from a pilot.
CROWD = 8192
TILE = 1024
#: What sending a vector costs, as a number of comparisons.
SENDING = 4096
PILOT = 20_000
BLOCK = 1024


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    peak = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / peak
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def passes_for(bits: int, least: float = SIMILARITY, miss: float = MISS) -> int:
    """The passes after which a pair at the cosine ``least`` has shared no cell with probability ``miss`` at most."""
    meet = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    return 1 if meet >= 1 else math.ceil(math.log(miss) / math.log1p(-meet))


def _hashed(seed: int, with_vectors: bool):
    """(pass, label, dims, bits, code, point) of each vector in each of its passes; the first hash leads ``code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, most = batch.column("dims").to_numpy(), batch.column("passes").to_numpy()
            for size, passes in sorted(set(zip(dims.tolist(), most.tolist(), strict=True))):
                rows = batch.filter(pa.array((dims == size) & (most == passes)))
                unit = _unit(_vectors(rows.column("embedding")))
                names = ["label", "dims", "bits", "point", *(["embedding"] if with_vectors else [])]
                for k in range(passes):
                    planes = np.random.default_rng([seed, size, k]).standard_normal((HASHES, size))
                    codes = (unit @ planes.T > 0) @ (1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64))
                    columns = [pa.array(np.full(len(codes), k, dtype=np.int32)), pa.array(codes.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, *map(rows.column, names)], ["pass", "code", *names])

    return run


_CODED = "pass int, code long, label long, dims int, bits int, point long"
_RUN = ["pass", "label", "dims", "start"]
_REGION = ["pass", "label", "dims", "region", "one", "two"]


def _plans(points: DataFrame, least: float, miss: float, seed: int) -> DataFrame:
    """(label, dims, n, bits, passes): how the points of each label and vector length are compared.

    The crowding of beginnings is counted on a bounded pilot of each large label with
    hyperplanes of its own.  It decides the cost alone: any number of bits keeps
    the bound.
    """
    sizes = kept(points.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))).frame
    pilot = (
        points.join(sizes.where(F.col("n") > CROWD), ["label", "dims"])
        .where(F.pmod(F.xxhash64("point", F.lit(seed)), F.col("n")) < PILOT)
        .select("label", "dims", F.lit(HASHES).alias("bits"), F.lit(1).alias("passes"), "point", "embedding")
        .mapInArrow(_hashed(seed + 1, False), _CODED)
    )
    crowds = (
        pilot.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(HASHES))))
        .groupBy("label", "dims", "bits", _start("bits").alias("start"))
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
        .groupBy("label", "dims", "bits")
        .agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    )
    passes = F.array(*[F.lit(passes_for(k, least, miss)) for k in range(HASHES + 1)])
    cost = F.get(passes, F.col("bits")) * (WINDOW + F.col("pairs") / F.col("m") * F.col("n") / F.col("m") + SENDING)
    best = crowds.join(sizes, ["label", "dims"]).groupBy("label", "dims").agg(F.min(F.struct(cost.alias("cost"), "bits")).alias("best"))
    even = F.least(F.greatest(F.ceil(F.log2(F.col("n") / WINDOW)), F.lit(0)), F.lit(HASHES))
    planned = sizes.join(best, ["label", "dims"], "left").select("label", "dims", "n", F.coalesce("best.bits", even).cast("int").alias("bits"))
    return kept(planned.withColumn("passes", F.get(passes, F.col("bits")))).frame


def _start(bits: str) -> F.Column:
    """The first ``bits`` hashes of a code."""
    return F.expr(f"shiftright(code, {HASHES} - ({bits}))")


class _Links:
    """Links between positions 0..n-1, united in lots."""

    LOT = 1 << 18

    def __init__(self, n: int) -> None:
        self.forest, self.held, self.count = Forest(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.count += len(a)
        if self.count > self.LOT:
            self.unite()

    def unite(self) -> None:
        if self.count:
            self.forest.link(*(np.concatenate(side) for side in zip(*self.held, strict=True)))
        self.held, self.count = [], 0

    def rows(self, points: np.ndarray) -> pa.RecordBatch:
        """A spanning forest of the links, as rows (a, b)."""
        self.unite()
        root = self.forest.roots()
        hung = np.flatnonzero(root != np.arange(len(points)))
        return pa.RecordBatch.from_arrays([pa.array(points[hung]), pa.array(points[root[hung]])], ["a", "b"])


def _window_links(least: float, window: int):
    """A spanning forest of the links between neighbours, from rows in order.

    Within a beginning (or a pair of parts of it) all pairs are compared; past its end
    the next ``window`` vectors of the region, where rows are carried over from table to table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in in_groups(batches, [*_REGION, "start"], 1 << 13):
            carried = 0 if held is None else held.num_rows
            rows = rows if held is None else pa.concat_tables([held, rows])
            points, own, one, two, size = (rows.column(c).to_numpy() for c in ("point", "own", "one", "two", "dims"))
            links = _Links(len(points))
            starts = group_starts(rows.slice(carried), [*_REGION, "start"]) + carried
            region = np.searchsorted(group_starts(rows, _REGION), np.arange(len(points)), side="right")
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                unit = _unit(_vectors(rows.column("embedding").take(pa.array(at))))
                place = np.full(len(points), -1)
                place[at] = np.arange(len(at))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(points)], strict=True):
                    if size[a] != dims or b - a < 2:
                        continue
                    first = a + np.flatnonzero(own[a:b] == one[a])
                    second = a + np.flatnonzero(own[a:b] == two[a])
                    for i in range(0, len(first), TILE):
                        for j in range(i if one[a] == two[a] else 0, len(second), TILE):
                            left, right = first[i : i + TILE], second[j : j + TILE]
                            x, y = np.nonzero(unit[place[left]] @ unit[place[right]].T >= least)
                            apart = left[x] != right[y]
                            links.add(left[x[apart]], right[y[apart]])
                for k in range(1, min(window, len(at) - 1) + 1):
                    near = (region[at[k:]] == region[at[:-k]]) & (np.einsum("ij,ij->i", unit[k:], unit[:-k]) >= least)
                    links.add(at[k:][near], at[:-k][near])
            yield links.rows(points)
            held = rows.slice(max(0, len(points) - window))

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of parts (one, two) that its own part is in."""
    return rows.withColumn("own", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *rows.columns, "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
    )


def _ordered(points: DataFrame, plans: DataFrame, seed: int, road: str) -> DataFrame:
    """The points once for each pass and pair of parts, in regions and in order within them."""
    names = ["label", "dims", "bits", "passes", "point", "embedding"]
    large = points.join(plans.where(F.col("n") > CROWD), ["label", "dims"]).select(*names)
    crowded = large.mapInArrow(_hashed(seed, False), _CODED).withColumn("start", _start("bits")).groupBy(*_RUN).agg(F.ceil(F.count(F.lit(1)) / F.lit(CROWD)).cast("int").alias("parts"))
    crowded = kept(crowded.where("parts > 1")).frame
    coded = points.join(plans, ["label", "dims"]).select(*names).mapInArrow(_hashed(seed, True), f"{_CODED}, embedding array<{road}>")
    coded = coded.withColumn("start", _start("bits")).withColumn("region", _start(f"greatest(bits - {REGION}, 0)"))
    placed = _dealt(coded.join(crowded, _RUN, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))).drop("parts", "bits")
    return placed.repartition(*_REGION).sortWithinPartitions(*_REGION, "code", "point")


def _links(points: DataFrame, least: float, miss: float, seed: int, road: str) -> DataFrame:
    """Edges (a, b) between points that link, enough for the components."""
    points = points.select("label", F.size("embedding").alias("dims"), "point", F.col("embedding").cast(f"array<{road}>").alias("embedding"))
    plans = _plans(points, least, miss, seed)
    return _ordered(points, plans, seed, road).mapInArrow(_window_links(least, WINDOW), "a long, b long")


def _block_counts(least: float):
    """Per point the weight of its links within the pair of parts (one, two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["root", "one", "two"]
        for rows in in_groups(batches, keys, 1 << 13):
            starts = group_starts(rows, keys)
            points, own, weight = (rows.column(c).to_numpy() for c in ("point", "own", "weight"))
            one, two = rows.column("one").to_numpy(), rows.column("two").to_numpy()
            unit = _unit(_vectors(rows.column("embedding")))
            links = np.zeros(len(points), dtype=np.int64)
            for a, b in zip(starts, np.append(starts[1:], len(points)), strict=True):
                if one[a] == two[a]:
                    near = unit[a:b] @ unit[a:b].T >= least
                    np.fill_diagonal(near, False)
                    links[a:b] = near @ weight[a:b]
                else:
                    first = a + np.flatnonzero(own[a:b] == one[a])
                    second = a + np.flatnonzero(own[a:b] == two[a])
                    near = unit[first] @ unit[second].T >= least
                    links[first] = near @ weight[second]
                    links[second] = near.T @ weight[first]
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(links)], ["point", "links"])

    return run


def usable(embedding: F.Column) -> F.Column:
    """True for a vector with finite components that are not all zero."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    embedding_col: str = "embedding",
    label_col: str = "label",
    least: float = SIMILARITY,
    miss: float = MISS,
    seed: int = 7,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link when their labels are equal and not null and their cosine is at
    least ``least``; a pair at ``least`` that nothing else connects is missed with
    probability ``miss`` at most.  A vector that is null, empty, zero, or holds a null or
    non-finite component, and one without a label, links with nothing.  Vectors of
    different length never link.  Rows that repeat a vector link with each other;
    rows that repeat an id count as vectors of their own but share its component.
    A row without an id is kept, with itself (null) as its component.
    """
    base = rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(embedding_col).cast("array<double>").alias("embedding"),
    )
    sound = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    points = kept(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("weight"))).frame
    single = isinstance(rows.schema[embedding_col].dataType.elementType, FloatType)
    found = components(_links(points, least, miss, seed, "float" if single else "double")).select(F.col("node").alias("point"), "root")
    member = kept(points.join(found, "point"))
    sizes = member.frame.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    placed = (
        member.frame.join(sizes, "root")
        .withColumn("own", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("root", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "point", "weight", "embedding")
    )
    keys = ["root", "one", "two"]
    counted = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_block_counts(least), "point long, links long")
    links = counted.groupBy("point").agg(F.sum("links").alias("links"))
    known = (
        points.select("label", "embedding", "point", "weight")
        .join(links, "point", "left")
        .join(found, "point", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "point").alias("component_id"),
        )
    )
    known = known.select(F.xxhash64("label", "embedding").alias("same"), F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id")
    sought = base.withColumn("same", F.xxhash64("label", "embedding"))
    joined = sought.join(known, (sought["same"] == known["same"]) & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
       vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN links ON vec_id = links.a
"""
