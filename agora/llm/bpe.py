"""Byte-pair encoding and decoding.

The encoder backtracks: at each place it takes the longest token an Aho-Corasick
automaton has found there and goes on when that token may follow the one before;
else it tries the next shorter token, and where none is left it takes the last
token back.  Whether two tokens may stand side by side is a property of the pair:
merging them apart and together must not meet an earlier merge across the border.
Answers are kept in a table.  Every place is given up at most once, so the work is
linear in the text, and the result equals that of doing all merges in order.

Decoding gathers bytes from one table of all tokens' bytes by their offsets.

Merges never cross the pre-tokens of a text.  These repeat a lot, so each distinct
one is encoded once and kept, up to a bounded number of them.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import by_bytes, fresh_name, table, texts_of, worker_table
from agora.llm.pretokens import WordMemory, pre_tokens


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    """A byte-level vocabulary; ids and merge order are those of its file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.id_of = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.sizes = [len(b) for b in self.bytes_of]
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        # Single bytes have rank -1: they come before every merge and do not split.
        self.rank = dict.fromkeys(self.id_of.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for order, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.id_of[bytes(letters[c] for c in a)], self.id_of[bytes(letters[c] for c in b)]
            whole = self.id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.merge[left, right] = order
            if whole not in self.parts:
                self.parts[whole] = (left, right)
                self.rank[whole] = order
        self.words = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.words.add_word(b.decode("latin-1"), i)
        self.words.make_automaton()
        # The next shorter token that begins each token.
        self.shorter: dict[int, int | None] = {}
        for b, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.id_of), None)
        self.fits: dict[tuple[int, int], bool] = {}
        self.words_seen = WordMemory(self._word)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging in order leaves ``a`` and ``b`` side by side."""
        key = (a, b)
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, parts, merge = self.rank, self.parts, self.merge
        before = 1 << 60  # merges across the border that come before this one would have happened
        fits = True
        while True:
            across = merge.get((a, b))
            if across is not None and across < before:
                fits = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            # Undo the later of the two merges; on equal ranks the left one happens first.
            if ra > rb:
                before, a = ra, parts[a][1]
            else:
                before, b = rb + 1, parts[b][0]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.id_of.get(word)
        if whole is not None and (whole in self.parts or len(word) == 1):
            return (whole,)
        letters = word.decode("latin-1")
        # The longest token at every step: right when each may follow the one before.
        greedy = [token for _, token in self.words.iter_long(letters)]
        fits = self.fits
        for pair in pairwise(greedy):
            if not (fits[pair] if pair in fits else self.may_follow(*pair)):
                return self._backtrack(word, letters)
        return tuple(greedy)

    def _backtrack(self, word: bytes, letters: str) -> tuple[int, ...]:
        n = len(word)
        sizes = self.sizes
        longest = [0] * n
        for end, token in self.words.iter(letters):
            longest[end - sizes[token] + 1] = token
        open_at = bytearray(b"\1") * (n + 1)
        shorter, may_follow = self.shorter, self.may_follow
        tokens: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = tokens[-1] if tokens else None
            while token is not None:
                end = at + sizes[token]
                if open_at[end] and (last is None or may_follow(last, token)):
                    break
                token = shorter[token]
            if token is None:
                open_at[at] = 0
                token = tokens.pop()
                at -= sizes[token]
                continue
            tokens.append(token)
            at = end
            if at == n:
                return tuple(tokens)
            token = longest[at]

    def _word(self, word: str) -> bytes:
        ids = self.encode_bytes(word.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; strings of special tokens become their ids."""
        parts = self.cut(text) if self.cut and any(s in text for s in self.special) else [text]
        packed: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                packed.append(self.special[part].to_bytes(4, "little"))
            else:
                packed.append(self.words_seen.joined(pre_tokens(part)))
        return np.frombuffer(b"".join(packed), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are not UTF-8 become replacement characters."""
        ids = np.asarray(ids, dtype=np.int64)
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        shift = first - (ends - size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, size)
        return self.blob[where].tobytes().decode("utf-8", "replace")


def bpe(path: str) -> Bpe:
    """The vocabulary of a file, once per Python worker."""
    return worker_table(("bpe", path), lambda: Bpe(path))


def _added(column: str, source: str, kind: pa.DataType, values: Callable[[pa.Array], list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 4 << 20):
            yield batch.append_column(column, pa.array(values(batch.column(source)), type=kind))

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text in ``ids_col``; a null text has none.

    A column of that name would clash and is an error; all others are kept, and so
    are repeated rows.
    """
    if fresh_name(ids_col, docs.columns) != ids_col:
        raise ValueError(f"there is a column {ids_col} already")
    add = _added(ids_col, text_col, pa.list_(pa.int32()), lambda column: [bpe(path).encode(t).astype(np.int32) for t in texts_of(column)])
    return docs.mapInArrow(add, docs.select("*", F.lit(None).cast("array<int>").alias(ids_col)).schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids of every row in ``text_col``; null ids give an empty text."""
    if fresh_name(text_col, rows.columns) != text_col:
        raise ValueError(f"there is a column {text_col} already")

    def texts(column: pa.Array) -> list[str]:
        return [bpe(path).decode(ids.values.to_numpy() if ids.is_valid else []) for ids in column]

    add = _added(text_col, ids_col, pa.string(), texts)
    return rows.mapInArrow(add, rows.select("*", F.lit("").alias(text_col)).schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without their texts, with the token ids and the text decoded from these.

    The same as ``encode`` and then ``decode``, by one Python worker instead of two
    with a vocabulary each.  A null text has no ids and decodes to an empty text;
    columns of the new names are an error, all others and repeated rows are kept.
    """
    for name in (ids_col, decoded_col):
        if fresh_name(name, docs.columns) != name:
            raise ValueError(f"there is a column {name} already")
    others = [F.col(c) for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 4 << 20):
            vocabulary = bpe(path)
            ids = [vocabulary.encode(t).astype(np.int32) for t in texts_of(batch.column(0))]
            decoded = pa.array([vocabulary.decode(i) for i in ids], pa.string())
            names = [*batch.schema.names[1:], ids_col, decoded_col]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.list_(pa.int32())), decoded], names)

    rows = docs.select(F.col(text_col), *others)
    return rows.mapInArrow(run, docs.select(*others, F.lit(None).cast("array<int>").alias(ids_col), F.lit("").alias(decoded_col)).schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
