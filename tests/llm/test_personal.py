import hashlib
import random
import re

import pytest

from agora.llm.personal import BASE, KINDS, cover, find_spans, luhn, personal_data, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    """The leftmost matches of the patterns themselves, failing ones dropped."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and plain_luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if valid:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def base_of(text):
    return [f"{s.kind}:{s.start}:{s.end}" for s in find_spans(text) if s.base]


def added(text):
    return [(s.kind, text[s.start : s.end]) for s in find_spans(text) if not s.base]


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_match_the_patterns(seed):
    rng = random.Random(seed)
    pieces = ["a@b.c", "@", ".", "-", " ", "+", "1", "22", "255", "256", "1.2.3.4", "4111 1111-1111 1111", "(", ")", "é", "x", "::", "tel", "\n", "0" * 5, "+1 (555) 12", "DE8", "%", "_"]
    for _ in range(200):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert base_of(text) == plain_base(text), text


def test_base_spans_of_chains():
    for text in ("1.2.3.4.5.6.7.8.9", "a@b.c+d@e.f@g.h", "4111111111111111 4111111111111111", "+1+2+3 4 5 6 7 8 9 10 11", "999.1.1.1.1", "001.002.0003.4", "+", "1", "٣.٣.٣.٣ +٣٣٣ ٣٣٣ ٣٣٣ ٣٣٣"):
        assert base_of(text) == plain_base(text), text


def test_card_of_both_lengths():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    for size in (11, 12, 19, 20):
        digits = next(d for d in (f"{k:0{size}d}" for k in range(10**6, 10**6 + 10)) if plain_luhn(d))
        assert base_of(f"x{digits}y") == ([f"card:1:{size + 1}"] if 12 <= size <= 19 else [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to josé.pérez@correo.es now", [("email", "josé.pérez@correo.es")]),
        ("или иван@почта.рф.", [("email", "иван@почта.рф")]),
        ("jane (at) example (dot) com", [("email", "jane (at) example (dot) com")]),
        ("jane[at]mail[dot]example[dot]org!", [("email", "jane[at]mail[dot]example[dot]org")]),
        ("host 2001:db8::8a2e:370:7334, up", [("ip", "2001:db8::8a2e:370:7334")]),
        ("at 12:30:45 in std::vector and a::b", []),
        ("Tel: (030) 123 456 78 please", [("phone", "(030) 123 456 78")]),
        ("hotel 1234567 rooms", []),
        ("IBAN DE89 3704 0044 0532 0130 00.", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("IBAN DE88 3704 0044 0532 0130 00.", []),
        ("account no. 123456789 closed", [("account", "123456789")]),
        ("account 12a of accounts", []),
        ("SSN: 123-45-6789", [("ssn", "123-45-6789")]),
        ("SSN: 000-45-6789, 123-45-6789", []),
        ("see ftp://bob:pw1@host.example/x, then", [("url", "ftp://bob:pw1@host.example/x")]),
        ("see https://host.example/a@b", []),
        ("mailto:me@example.com", []),
    ],
)
def test_added_spans(text, want):
    assert [a for a in added(text) if a[0] != "card"] == want


def test_very_long_texts_take_linear_time():
    for unit in ("a", "1", "1.", "a@", "@", "1 ", "+1", "a.", "::", "1:", "tel ", "DE8", "(at)", "://a:", "é@"):
        text = unit * (400_000 // len(unit))
        assert len(find_spans(text)) <= len(text)


def test_cover():
    assert cover("me@example.com or +1 (555) 555-0100, 10.0.0.1") == "[email] or [phone], [ip]"
    assert cover("") == "" and cover("clean") == "clean"


def test_operator_rows(spark, docs):
    rows = [(1, "a@b.cd 1.2.3.4"), (1, "a@b.cd 1.2.3.4"), (2, None), (3, ""), (None, "+49 30 1234567"), (5, "é" * 10 + "x@y.zz")]
    found = personal_data(docs(rows)).collect()
    got = sorted((str(r.doc_id), ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base)) for r in found)
    assert got == sorted((str(i), ",".join(plain_base(t))) for i, t in rows)
    assert {s.kind for r in found for s in r.spans} <= set(KINDS)
    assert personal_data(docs(rows).limit(0)).count() == 0
    hidden = redact(docs(rows).withColumnRenamed("fp", "spans"))
    assert hidden.columns[-1] == "spans" and {r.text for r in hidden.collect()} == {None, "", "[email] [ip]", "[phone]", "[email]"}


def test_query_on_the_tables(spark):
    from agora.llm.personal import op11_personal

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_personal(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(filter(None, r.spans.split(",")))
