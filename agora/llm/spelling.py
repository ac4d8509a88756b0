"""Spelling variants: words one edit apart, found in k-d trees over their letter counts.

One inserted, deleted or replaced letter changes the vector of letter counts by an L1
distance of two at most: one count rises, one falls, or both.  So for each pair of
lengths, equal or differing by one, the words of one length are searched for those of the
other in a k-d tree.  A search goes down to both sides of a cut only where the letter of
the cut can still rise or fall across it, and what it finds in a leaf is verified letter
by letter.

The first levels of the trees are drawn from a bounded sample of the vocabulary and cut it
into shards: a word is at home in one, and visits those that an edit can reach.  The
sample settles only how even the shards are.  A shard that is still too large is dealt in
parts that every visitor sees, so no set of words is too large for a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import by_bytes, group_starts, in_groups, kept, table

SHORTEST = 7
LEAST = 2
#: How many times more frequent a form is than the word it stands for.
RATIO = 10
#: Words of a shard, about, and words of a leaf.
SHARD = 1 << 15
LEAF = 16
#: The vocabulary the first cuts are drawn from: so many words, none longer than this.
SAMPLE = 50_000
SAMPLED_LENGTH = 64
#: Bytes that a comparison of letters may hold.
BLOCK = 1 << 24

# Letters are A-Z, a-z and U+00C0 to U+00FF, all of them single bytes in Latin-1.
RUN = f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"
_LETTERS = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_place = np.zeros(256, dtype=np.uint8)
_place[_LETTERS] = np.arange(len(_LETTERS))

INSERTED, REPLACED = 1, 0
_NONE = -1


def codes_of(words: list[str]) -> np.ndarray:
    """The letters of words of one length as a matrix of bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """The letter counts of each row."""
    n, length = codes.shape
    counts = np.zeros((n, len(_LETTERS)), dtype=np.int16 if length < 1 << 15 else np.int64)
    places = _place[codes]
    if length > n:
        for k in range(n):
            counts[k] = np.bincount(places[k], minlength=len(_LETTERS))
    else:
        rows = np.arange(n)
        for k in range(length):
            counts[rows, places[:, k]] += 1
    return counts


class KdTree:
    """Cuts at a letter count: a vector goes left if its count is at most the cut's."""

    def __init__(self, counts: np.ndarray, leaf: int) -> None:
        self.letter: list[int] = []
        self.cut: list[int] = []
        self.sides: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []
        self._build(counts, leaf)

    def _build(self, counts: np.ndarray, leaf: int) -> None:
        todo = [(np.arange(len(counts)), None)]
        while todo:
            rows, above = todo.pop()
            node = len(self.letter)
            if above is not None:
                parent, side = above
                self.sides[parent] = (node, self.sides[parent][1]) if side == 0 else (self.sides[parent][0], node)
            inside = counts[rows]
            best = _cut(inside) if len(rows) > leaf else None
            if best is None:
                self.letter.append(_NONE)
                self.cut.append(len(self.leaves))
                self.sides.append((_NONE, _NONE))
                self.leaves.append(rows)
                continue
            letter, cut = best
            self.letter.append(letter)
            self.cut.append(cut)
            self.sides.append((_NONE, _NONE))
            low = inside[:, letter] <= cut
            todo += [(rows[low], (node, 0)), (rows[~low], (node, 1))]

    def reach(self, counts: np.ndarray, mode: int, rising: np.ndarray, falling: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(leaf, rows, rising, falling): the leaves that one edit of each row can lie in, each once.

        A row may be known to have gained the letter ``rising`` or lost ``falling``
        already.  An inserted letter only rises.  Of the two words of a replacement the
        one whose letter comes first searches for the other, so a letter rises only
        above the one that falls.
        """
        todo = [(0, np.arange(len(counts)), rising, falling)]
        while todo:
            node, rows, up, down = todo.pop()
            letter, cut = self.letter[node], self.cut[node]
            if letter == _NONE:
                yield cut, rows, up, down
                continue
            now = counts[rows, letter] + (up == letter) - (down == letter)
            low = now <= cut
            rises = (now == cut) & (up == _NONE) & (letter > down)
            sides = [(low, None), (~low, None), (rises, "up")]
            if mode == REPLACED:
                sides.append(((now == cut + 1) & (down == _NONE) & ((up == _NONE) | (letter < up)), "down"))
            gathered: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]
            for side, (able, moved) in enumerate(sides):
                if able.any():
                    u, d = up[able], down[able]
                    if moved == "up":
                        u = np.full_like(u, letter)
                    elif moved == "down":
                        d = np.full_like(d, letter)
                    # Rising goes to the right and falling to the left.
                    gathered[(0, 1, 1, 0)[side]].append((rows[able], u, d))
            for child, parts in zip(self.sides[node], gathered, strict=True):
                if parts:
                    todo.append((child, *(np.concatenate(p) for p in zip(*parts, strict=True))))

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The leaf each row lies in."""
        found = np.zeros(len(counts), dtype=np.int32)
        todo = [(0, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            letter, cut = self.letter[node], self.cut[node]
            if letter == _NONE:
                found[rows] = cut
                continue
            low = counts[rows, letter] <= cut
            todo += [(child, rows[side]) for child, side in zip(self.sides[node], (low, ~low), strict=True) if side.any()]
        return found


def _cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter that varies most and the cut nearest its median; None if all rows are equal."""
    total = counts.sum(axis=0, dtype=np.float64)
    spread = np.einsum("ij,ij->j", counts, counts, dtype=np.float64) - total * total / len(counts)
    letter = int(spread.argmax())
    column = counts[:, letter]
    least, most = int(column.min()), int(column.max())
    if least == most:
        return None
    middle = int(np.partition(column, len(column) // 2)[len(column) // 2])
    cuts = [c for c in (middle - 1, middle) if least <= c < most]
    return letter, min(cuts, key=lambda c: abs(2 * int((column <= c).sum()) - len(column)))


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of rows that differ in one letter, the one of ``a`` coming first."""
    differ = a[:, None, :] != b[None, :, :]
    x, y = np.nonzero(differ.sum(axis=2) == 1)
    at = differ[x, y].argmax(axis=1)
    right = a[x, at] < b[y, at]
    return np.stack([x[right], y[right]])


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of rows where ``b`` is ``a`` with one more letter."""
    length = a.shape[1]

    def run(equal: np.ndarray) -> np.ndarray:
        return np.where(equal.all(axis=2), length, equal.argmin(axis=2)) if length else np.zeros(equal.shape[:2], dtype=int)

    begin = run(a[:, None, :] == b[None, :, :-1])
    end = run(a[:, None, ::-1] == b[None, :, :0:-1])
    return np.stack(np.nonzero(begin + end >= length))


def pairs(points: np.ndarray, seekers: np.ndarray, mode: int, rising: np.ndarray, falling: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """(seeker, point) of the rows one edit apart; of a replacement, once for both words."""
    tree = KdTree(counts_of(points), leaf)
    verify = inserted if mode == INSERTED else replaced
    found = []
    for at, rows, _, _ in tree.reach(counts_of(seekers), mode, rising, falling):
        near = tree.leaves[at]
        # Both sides are cut to the same bound, however long the words are.
        wide = max(1, min(len(near), BLOCK // max(1, points.shape[1])))
        step = max(1, BLOCK // max(1, wide * points.shape[1]))
        for k in range(0, len(near), wide):
            some = points[near[k : k + wide]]
            for r in range(0, len(rows), step):
                x, y = verify(seekers[rows[r : r + step]], some)
                if len(x):
                    found.append(np.stack([rows[r + x], near[k + y]]))
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for length in np.unique(sizes):
        yield int(length), np.flatnonzero(sizes == length)


def _homes(trees: dict[int, KdTree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = batch.column(0).to_pylist()
            for length, rows in _by_length(words):
                homes = np.zeros(len(rows), dtype=np.int32)
                if length in trees:
                    homes = trees[length].home(counts_of(codes_of([words[k] for k in rows])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), length, dtype=np.int32)), pa.array(homes)], ["length", "shard"])

    return run


_DEALT = "length int, shard int, role int, rising int, falling int, word string, n long"
HOME = 2


def _dealt(trees: dict[int, KdTree]):
    """Every word at home, and in all shards of its length and the next one that an edit of it can lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1 << 20):
            words = batch.column(0).to_pylist()
            for length, rows in _by_length(words):
                shards = [(length, mode) for mode in (HOME, REPLACED)] + [(length + 1, INSERTED)]
                counts = None
                for size, mode in shards:
                    whole = np.arange(len(rows))
                    none = np.full(len(rows), _NONE, dtype=np.int32)
                    if size not in trees:
                        visits = [(0, whole, none, none)]
                    else:
                        counts = counts_of(codes_of([words[k] for k in rows])) if counts is None else counts
                        visits = [(trees[size].home(counts), whole, none, none)] if mode == HOME else trees[size].reach(counts, mode, none, none)
                    for shard, some, up, down in visits:
                        taken = pa.array(rows[some])
                        columns = [
                            np.full(len(some), size, dtype=np.int32),
                            np.broadcast_to(np.asarray(shard, dtype=np.int32), len(some)),
                            np.full(len(some), mode, dtype=np.int32),
                            up.astype(np.int32),
                            down.astype(np.int32),
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [*map(pa.array, columns), batch.column(0).take(taken), batch.column(1).take(taken)],
                            ["length", "shard", "role", "rising", "falling", "word", "n"],
                        )

    return run


_KEYS = ["length", "shard", "part"]
_LINKS = "word string, n_near long, form string, form_n long"


def _best(own: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, links, best): of each row of ``own`` the partner with the largest n; of equals the first."""
    order = np.lexsort((other, -n[other], own))
    own, other = own[order], other[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[starts], np.diff(np.append(starts, len(own))), other[starts]


def _linked(leaf: int):
    """For each word that has any: its near words within the shard, counted, and the most frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_groups(by_bytes(batches), _KEYS):
            starts = group_starts(rows, _KEYS)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
                yield from shard(rows.slice(a, b - a).combine_chunks())

    def shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        role, n = rows.column("role").to_numpy(), rows.column("n").to_numpy()
        up, down = rows.column("rising").to_numpy(), rows.column("falling").to_numpy()
        words = rows.column("word").combine_chunks()
        home = np.flatnonzero(role == HOME)
        if not len(home):
            return
        points = codes_of(words.take(pa.array(home)).to_pylist())
        for mode in (REPLACED, INSERTED):
            seek = np.flatnonzero(role == mode)
            if not len(seek):
                continue
            x, y = pairs(points, codes_of(words.take(pa.array(seek)).to_pylist()), mode, up[seek], down[seek], leaf)
            if not len(x):
                continue
            x, y = seek[x], home[y]
            for own, links, best in (_best(x, y, n), _best(y, x, n)):
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(own)), pa.array(links.astype(np.int64)), words.take(pa.array(best)), pa.array(n[best])], ["word", "n_near", "form", "form_n"]
                )

    return run


def _trees(words: DataFrame, shard: int, sample: int) -> dict[int, KdTree]:
    """The first cuts for every length that has more words than a shard should.

    About ``sample`` words, chosen by a hash at a rate that follows from their number,
    none longer than ``SAMPLED_LENGTH``, reach the driver; longer words are parted by a
    hash alone.
    """
    short = words.where(F.length("word") <= SAMPLED_LENGTH)
    sizes = {r["size"]: r["count"] for r in short.groupBy(F.length("word").alias("size")).count().collect()}
    total = max(1, sum(sizes.values()))
    chosen = sorted(r["word"] for r in short.where(F.pmod(F.xxhash64("word"), F.lit(total)) < sample).select("word").collect())
    trees = {}
    for length, rows in _by_length(chosen):
        if sizes[length] > shard:
            trees[length] = KdTree(counts_of(codes_of([chosen[k] for k in rows])), max(1, int(len(rows) * shard / sizes[length])))
    return trees


def near_words(words: DataFrame, shard: int = SHARD, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have a near one: how many, and the most frequent.

    ``words`` are distinct (word, n) of letters A-Z, a-z and U+00C0 to U+00FF.
    """
    trees = _trees(words, shard, sample)
    sizes = words.select("word").mapInArrow(_homes(trees), "length int, shard int").groupBy("length", "shard").count()
    crowded = kept(sizes.where(F.col("count") > 2 * shard).select("length", "shard", F.ceil(F.col("count") / shard).cast("int").alias("parts"))).frame
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = (
        words.select("word", "n")
        .mapInArrow(_dealt(trees), _DEALT)
        .join(F.broadcast(crowded), ["length", "shard"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.explode(F.when(F.col("role") == HOME, F.array(own)).otherwise(every)))
        .drop("parts")
    )
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartition(tasks, *_KEYS).sortWithinPartitions(*_KEYS, "role", "word")
    found = placed.mapInArrow(_linked(leaf), _LINKS)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form"))).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer jumping.

    A form is at least ``RATIO`` times as frequent as its word, so no chain of n steps has
    a last word less frequent than RATIO ** n, and a few rounds reach all ends.
    """
    rows = kept(forms.select("word", F.col("form").alias("root"))).frame
    while True:
        above = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = kept(rows.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        rows = jumped.frame.select("word", "root")
        if not jumped.frame.where("moved").limit(1).count():
            return rows


def spelling_variants(words: DataFrame, ratio: int = RATIO, shard: int = SHARD, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every one of the distinct ``words`` (word, n).

    Two words are near if one inserted, deleted or replaced letter turns one into the
    other.  A word's form is its most frequent near word, the first of equals, if that is
    ``ratio`` times as frequent; its root is the end of the chain of forms.
    """
    words = kept(words.select("word", "n")).frame
    near = near_words(words, shard, leaf, sample)
    enough = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    judged = kept(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("form")).alias("form"),
            F.when(enough, F.col("form_n")).alias("form_n"),
        )
    ).frame
    roots = _roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def lower_letters(word: Column) -> Column:
    """The word with A-Z alone in lower case."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(word.rlike("[À-Þ]"), F.translate(word, capitals, capitals.lower())).otherwise(F.lower(word))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): every run of letters of at least ``SHORTEST``, as often as it occurs; a null text has none."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))
    return rows.select("id", lower_letters(F.col("run")).alias("word"))


def counted(rows: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    long = rows.where(F.length("word") >= shortest)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def misspelt(rows: DataFrame, every: int = 31) -> DataFrame:
    """``rows`` (id, word) with a letter deleted from one occurrence in ``every``, settled by a checksum.

    A row without id keeps its word.
    """
    mark = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("mark") % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return rows.withColumn("mark", mark).select("id", F.when(F.col("mark") % every == 0, shorter).otherwise(F.col("word")).alias("word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = counted(misspelt(runs(table(spark, sf_dir, "documents"))))
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
