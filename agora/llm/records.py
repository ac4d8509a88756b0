"""Token sequences in files of length-delimited binary records.

A file holds documents in ascending id order.  One record is

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of the length
    payload  doc_id (8 bytes, signed), flags (4 bytes), number of ids (4 bytes),
             the ids (2 bytes each if the vocabulary has at most 65,536, else 4)
    check    4 bytes: masked CRC-32 of the payload

and the file ``NAME.idx`` beside it lists (offset, length) of every record, 8
bytes each, so that records can be read in any order.

Every task writes files under names of its own attempt and returns one row for
each; only files in the returned rows count, so a repeated or lost task leaves no
wrong data behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.llm.bpe import byte_letters, vocabulary_path
from agora.llm.common import by_bytes, kept, table, texts_of
from agora.llm.pretokens import WordMemory, pre_tokens
from agora.session import shared_dir

END_ID = 2
FILE_BYTES = 128 << 20
HEAD = "<QI"
PAYLOAD = "<qII"
PAYLOAD_BYTES = struct.calcsize(PAYLOAD)
NULL_ID = 1


class WordCache:
    """A tokenizers file whose pre-tokens are encoded by the library's model once each.

    Merges never cross a pre-token, so the ids of a text are those of its
    pre-tokens in order.  Texts with the string of an added token go to the
    library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.model = self.tokenizer.model
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.seen = WordMemory(self._word)

    def _word(self, word: str) -> bytes:
        shown = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(self.seen.joined(pre_tokens(text)), dtype="<u4")


_loaded: dict[str, WordCache] = {}


def _tokenizer(path: str) -> WordCache:
    if path not in _loaded:
        _loaded[path] = WordCache(path)
    return _loaded[path]


def masked(data: bytes) -> int:
    """A CRC-32, rotated and shifted, so that checks of data with checks in it stay sound."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of one whole record; raises where a check fails."""
    length, check = struct.unpack_from(HEAD, data)
    if masked(bytes(data[:8])) != check or len(data) != length + 16:
        raise ValueError("a record's length is damaged")
    payload = data[12 : 12 + length]
    if masked(payload) != struct.unpack_from("<I", data, 12 + length)[0]:
        raise ValueError("a record's payload is damaged")
    return payload


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _write(folder: str, vocabulary: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        kind = "<u4" if tokenizer.wide else "<u2"
        files, place = _filesystem(folder)
        out, part = None, 0
        for batch in by_bytes(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if out is None:
                    name = f"tokens-{uuid.uuid4().hex}"
                    out = files.open_output_stream(f"{place}/{name}.rec")
                    at, index, tokens, first = 0, [], 0, doc_id
                ids = np.append(tokenizer.encode(text), np.uint32(end_id))
                null = doc_id is None
                record = frame(struct.pack(PAYLOAD, 0 if null else doc_id, NULL_ID if null else 0, len(ids)) + ids.astype(kind).tobytes())
                out.write(record)
                index += (at, len(record))
                at += len(record)
                tokens += len(ids)
                if at >= file_bytes:
                    yield _closed(files, place, name, out, index, tokens, first, part)
                    out, part = None, part + 1
        if out is not None:
            yield _closed(files, place, name, out, index, tokens, first, part)

    return run


def _closed(files, place, name, out, index, tokens, first, part) -> pa.RecordBatch:
    out.close()
    with files.open_output_stream(f"{place}/{name}.idx") as side:
        side.write(np.array(index, dtype="<u8").tobytes())
    return pa.RecordBatch.from_pydict(
        {
            "file": pa.array([name]),
            "first_id": pa.array([first], pa.int64()),
            "part": pa.array([part], pa.int32()),
            "records": pa.array([len(index) // 2], pa.int64()),
            "tokens": pa.array([tokens], pa.int64()),
            "bytes": pa.array([index[-2] + index[-1]], pa.int64()),
        }
    )


def write_records(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode every whole text and write the records; returns the files, in order of ``first_id``.

    Rows: (file, first_id, part, start, records, tokens, bytes); ``start`` counts the ids
    in all files before.  ``folder`` must be one that all executors and pyarrow can
    reach.  A null text is empty and has only the end id; a null id sorts first.
    Rows with equal ids stand side by side.  Without rows there are no files.
    """
    files, place = _filesystem(folder)
    files.create_dir(place, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    schema = "file string, first_id long, part int, records long, tokens long, bytes long"
    written = kept(ordered.mapInArrow(_write(folder, vocabulary, end_id, file_bytes), schema)).frame
    # One row per file; files with equal first ids are of one task, which numbered them.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(folder: str, wide: bool):
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{place}/{file}.idx") as side:
                    index = np.frombuffer(side.read(), dtype="<u8").reshape(-1, 2).astype(np.int64)
                with files.open_input_file(f"{place}/{file}.rec") as data:
                    at = 0
                    while at < len(index):
                        # As many records as make about 4 MB, one at least.
                        reach = np.searchsorted(index[:, 0], index[at, 0] + (4 << 20))
                        upto = max(at + 1, int(reach))
                        base = int(index[at, 0])
                        chunk = memoryview(data.read_at(int(index[upto - 1].sum()) - base, base))
                        ids, starts, lists = [], [], []
                        for offset, length in index[at:upto].tolist():
                            payload = unframe(chunk[offset - base : offset - base + length])
                            doc_id, flags, count = struct.unpack_from(PAYLOAD, payload)
                            ids.append(None if flags & NULL_ID else doc_id)
                            starts.append(start)
                            lists.append(np.frombuffer(payload, dtype=kind, offset=PAYLOAD_BYTES, count=count).astype(np.int32))
                            start += count
                        at = upto
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "start", "ids"]
                        )

    return run


def read_records(files: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """(doc_id, start, ids) of every record of the listed files, each record checked."""
    wide = _tokenizer(vocabulary).wide
    spread = files.select("file", "start").repartition("file")
    return spread.mapInArrow(_read(folder, wide), "doc_id long, start long, ids array<int>")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [zlib.crc32(ids.values.to_numpy().astype("<u4").tobytes()) for ids in batch.column(2)]
        counts = [len(ids.values) for ids in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocabulary_path()
    folder = f"{shared_dir(spark).rstrip('/')}/agora-tokens-{uuid.uuid4().hex}"
    files = write_records(table(spark, sf_dir, "documents"), folder, vocabulary)
    return read_records(files, folder, vocabulary).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
