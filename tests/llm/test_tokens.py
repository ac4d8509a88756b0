import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from agora.llm.bpe import Bpe, bpe, decode, encode, round_trip, vocabulary_path
from agora.llm.common import release
from agora.llm.pretokens import WordMemory
from agora.llm.records import WordCache, frame, masked, read_records, unframe, write_records

PARTS = ["a", "b", " ", "  ", "\n", "'s", "'S", "é", "日", "1", "²", "½", " ", "\x1c", "<|endoftext|>", "the", "###", "\t", "́", "​", "\U0001f600", "ing", "\r\n", "\x85"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(1500)]
    return [*made, "", " ", "x" * 3000, "the quick brown fox " * 2000, *("".join(rng.choice("etaoin shr") for _ in range(60)) for _ in range(500))]


def test_encoders_equal_the_library(texts):
    path = vocabulary_path()
    library, own, cached = Tokenizer.from_file(path), Bpe(path), WordCache(path)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want
        assert cached.encode(text).tolist() == want
        assert own.decode(np.array(want)) == library.decode(want, skip_special_tokens=False) == text
    assert own.decode(own.encode("日")[:1]) == library.decode(own.encode("日")[:1].tolist())


def test_tables_are_encoded_and_decoded(docs):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (3, "")]
    table = encode(docs(rows), vocabulary_path())
    back = decode(table, vocabulary_path()).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == [("1", "Hello world"), ("1", "Hello world"), ("3", ""), ("None", "")]
    assert decode(encode(docs([]), vocabulary_path()), vocabulary_path()).count() == 0
    with pytest.raises(ValueError):
        encode(docs(rows), vocabulary_path(), ids_col="FP")


def test_round_trip_equals_encoding_and_decoding(docs, texts):
    path = vocabulary_path()
    rows = docs([(1, "Hello world"), (1, "Hello world"), (None, None), (3, ""), *enumerate(texts[:200], 10)])
    two = decode(encode(rows, path).drop("text"), path)
    one = round_trip(rows.withColumn("kept", rows["doc_id"]), path)
    assert one.columns == [*(c for c in rows.columns if c != "text"), "kept", "ids", "decoded"]
    one = one.drop("kept")
    def plain(rows):
        return sorted((str(r.doc_id), r.decoded, r.ids) for r in rows.collect())

    assert plain(one) == plain(two)
    assert round_trip(docs([]), path).count() == 0
    with pytest.raises(ValueError):
        round_trip(rows.withColumnRenamed("doc_id", "Decoded"), path)


def test_released_tables_are_made_again():
    first = bpe(vocabulary_path())
    assert bpe(vocabulary_path()) is first
    release()
    assert bpe(vocabulary_path()) is not first


def test_word_memory_forgets_only_rare_words():
    asked = []
    memory = WordMemory(lambda w: asked.append(w) or w.encode(), most=3)
    for words in (["a", "b", "c"], ["a", "d"], ["e", "f", "g"], ["a"]):
        assert memory.joined(words) == "".join(words).encode()
    assert asked.count("a") == 1 and len(memory.young) + len(memory.old) <= 6 + 1


def test_frames_are_checked():
    record = frame(b"payload")
    assert bytes(unframe(memoryview(record))) == b"payload" and len(record) == 7 + 16
    crc = zlib.crc32(b"x")
    assert masked(b"x") == (((crc >> 15 | crc << 17) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF
    for at in range(len(record)):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            unframe(memoryview(bytes(bad)))


@pytest.mark.parametrize("file_bytes", [1 << 27, 60])
def test_files_hold_all_documents_in_order(docs, tmp_path, file_bytes):
    rows = [(k * 7 % 50, f"text {k} " * (k % 9)) for k in range(50)] + [(3, "again"), (3, "again"), (None, "no id"), (60, None)]
    path = vocabulary_path()
    files = write_records(docs(rows), str(tmp_path), path, file_bytes=file_bytes)
    found = read_records(files, str(tmp_path), path).collect()
    library = Tokenizer.from_file(path)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), tuple(r.ids), r.start) for r in found)
    want = sorted(((i if i is not None else -1), (*library.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    assert [g[:2] for g in got] == want
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in ordered] == sorted(w[0] for w in want)
    assert all(b.start == a.start + len(a.ids) for a, b in zip(ordered, ordered[1:], strict=False)) and ordered[0].start == 0
    assert files.count() > 1 if file_bytes == 60 else files.count() >= 1


def test_no_rows_make_no_files(docs, tmp_path):
    files = write_records(docs([]), str(tmp_path), vocabulary_path())
    assert files.count() == 0 and read_records(files, str(tmp_path), vocabulary_path()).count() == 0
