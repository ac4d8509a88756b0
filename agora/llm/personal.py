"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, schemes, pairs of
digits, and cues of identifiers.  At each anchor a deterministic parser expands to the
boundaries of the address or number and validates it.  A parser never looks again at
what the one of the same kind has consumed before, so the work is linear in the text.

The base spans are exactly the leftmost, non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     four dotted runs of digits, each at most 255
    card   digits with single blanks or hyphens between, 12 to 19 of them, Luhn's rule
    phone  a plus sign, digits, blanks, brackets, dots and hyphens, 9 to 15 digits

and further parsers add spans to them: emails with other letters or written with
"(at)" and "(dot)", IPv6 addresses, national phone numbers after a cue, IBANs by their
check digits, account and social security numbers after a cue, and addresses that
carry a password.

Offsets are code points, ends exclusive.  A null text has no spans; repeated rows are
kept; a null id stays null.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import by_bytes, table, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "ssn", "url")
_rank = {kind: k for k, kind in enumerate(KINDS)}

# The length of an IBAN by its country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
    "VG": 24, "XK": 20,
}
# Words after which a number is one of a phone, an account, or a person.
CUES = {
    "phone": ("tel", "phone", "telephone", "mobile", "fax", "telefon", "teléfono", "téléphone", "handy"),
    "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
}
_DIGITS = "0123456789"
_HEX = _DIGITS + "abcdefABCDEF"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Alphabets whose words stand between blanks, so that a run of letters is one word.
_LETTERS = "A-Za-zÀ-ɏͰ-ϿЀ-ӿ"
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
_dotted = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").match
_chain = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_international = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_wide_local = re.compile(rf"[{_LETTERS}0-9._%+-]").match
_wide_domain = re.compile(rf"(?:[{_LETTERS}0-9-]++\.(?=[{_LETTERS}0-9]))++[{_LETTERS}]{{2,}}+(?![{_LETTERS}0-9-])").match
_spelled = re.compile(r"(?:[A-Za-z0-9-]{1,63}\s?[(\[{](?:dot|DOT|Dot)[)\]}]\s?){1,8}[A-Za-z]{2,24}\b").match
_hextet = re.compile(r"[0-9A-Fa-f:.]{2,45}").match
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").match
_after_cue = re.compile(r"(?:\.|s?\b)(?:\s?(?:no|nr|number|num|nummer|#|n°)\b\.?)?\s?[:#=]?\s?(?=[0-9(])", re.IGNORECASE).match
_national = re.compile(r"\(?[0-9](?:[ ()./-]{0,2}[0-9])+").match
_account = re.compile(r"[0-9](?:[ -]?[0-9])+(?![0-9A-Za-z])").match
_ssn = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])").match
_secret_address = re.compile(r"://[^\s/@:<>\"']{1,256}:[^\s/@<>\"']{1,256}@[^\s<>\"']{1,2048}").match


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    odd = digits[::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _cased(word: str) -> set[str]:
    return {word, word.upper(), word.capitalize()}


def _anchors() -> ahocorasick.Automaton:
    """All anchors; each carries the parsers to run and its length."""
    found: dict[str, set[str]] = {}

    def add(pattern: str, parser: str) -> None:
        found.setdefault(pattern, set()).add(parser)

    add("@", "email")
    for a in _DIGITS:
        add("+" + a, "phone")
        for b in _DIGITS:
            for between in ("", " ", "-"):
                add(a + between + b, "card")
            add(a + "." + b, "ip")
        for country in IBAN_LENGTH:
            add(country + a, "iban")
    add("::", "ipv6")
    for a in _HEX:
        for b in _HEX:
            add(a + ":" + b, "ipv6")
    for opened, closed in ("()", "[]", "{}"):
        for at in _cased("at"):
            add(opened + at + closed, "spelled")
    add("://", "url")
    for kind, words in CUES.items():
        for word in words:
            for form in _cased(word):
                add(form, "cue_" + kind)
    automaton = ahocorasick.Automaton()
    for pattern, parsers in found.items():
        automaton.add_word(pattern, (len(pattern), tuple(sorted(parsers))))
    automaton.make_automaton()
    return automaton


_automaton: list[ahocorasick.Automaton] = []


class _Reader:
    """The parsers over one text; ``free[p]`` is where parser ``p`` may begin again."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.base: list[Span] = []
        self.more: list[Span] = []
        self.free: dict[str, int] = {}

    def take(self, parser: str, kind: str, start: int, end: int, valid: bool, base: bool = False) -> None:
        self.free[parser] = end
        if valid:
            (self.base if base else self.more).append(Span(kind, start, end, base))

    def email(self, start: int, end: int) -> None:
        text, floor = self.text, self.free.get("email", 0)
        left = start
        while left > floor and text[left - 1] in _LOCAL:
            left -= 1
        domain = _domain(text, end)
        if left < start and domain:
            self.take("email", "email", left, domain.end(), True, base=True)
        # With letters of other alphabets the address may reach further.
        floor, wide = self.free.get("wide", 0), start
        while wide > floor and _wide_local(text, wide - 1):
            wide -= 1
        while wide < start and text[wide] in ".-%+":
            wide += 1
        domain = _wide_domain(text, end)
        if wide < start and domain:
            self.take("wide", "email", wide, domain.end(), not text[wide : domain.end()].isascii())

    def spelled(self, start: int, end: int) -> None:
        text, floor = self.text, self.free.get("spelled", 0)
        stop = start - 1 if start > floor and text[start - 1] == " " else start
        left = stop
        while left > max(floor, stop - 64) and text[left - 1] in _LOCAL:
            left -= 1
        domain = _spelled(text, end + 1 if text[end : end + 1] == " " else end)
        if left < stop and domain:
            self.take("spelled", "email", left, domain.end(), True)

    def ip(self, start: int, end: int) -> None:
        text, floor = self.text, self.free.get("ip", 0)
        if start < floor:
            return
        while start > floor and text[start - 1] in _DIGITS:
            start -= 1
        if found := _dotted(text, start):
            parts = [p.lstrip("0") for p in found[0].split(".")]
            self.take("ip", "ip", start, found.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts), base=True)

    def ipv6(self, start: int, end: int) -> None:
        text, floor = self.text, self.free.get("ipv6", 0)
        if start < floor:
            return
        left = start
        while left > max(floor, start - 5) and text[left - 1] in _HEX:
            left -= 1
        found = _hextet(text, left)
        if found is None:
            return
        stop = found.end()
        while stop > left and text[stop - 1] == "." or text[stop - 1] == ":" and text[stop - 2] != ":":
            stop -= 1
        outside = (left and (text[left - 1].isalnum() or text[left - 1] in "_:.")) or text[stop : stop + 1].isalnum()
        self.free["ipv6"] = found.end()
        groups = [g for g in text[left:stop].split(":") if g]
        # Fewer groups, or none with a digit, are as likely a name in a program.
        if not outside and len(groups) >= 3 and any(c in _DIGITS for c in text[left:stop]):
            try:
                ipaddress.IPv6Address(text[left:stop])
            except ValueError:
                return
            self.more.append(Span("ip", left, stop, False))

    def card(self, start: int, end: int) -> None:
        if start < self.free.get("card", 0):
            return
        found = _chain(self.text, start)
        stop = found.end()
        few = stop - start <= 37 and _digits_of(found[0])
        self.take("card", "card", start, stop, bool(few) and 12 <= len(few) <= 19 and luhn(few), base=True)

    def phone(self, start: int, end: int) -> None:
        if found := _international(self.text, start):
            self.take("phone", "phone", start, found.end(), 9 <= len(_digits_of(found[0])) <= 15, base=True)

    def iban(self, start: int, end: int) -> None:
        text = self.text
        if start < self.free.get("iban", 0) or (start and text[start - 1].isalnum()):
            return
        if found := _iban(text, start):
            size, at, seen = IBAN_LENGTH[text[start : start + 2]], start, 0
            while at < found.end() and seen < size:
                seen += text[at] != " "
                at += 1
            if seen == size and not text[at : at + 1].isalnum():
                compact = text[start:at].replace(" ", "")
                number = "".join(str(int(c, 36)) for c in compact[4:] + compact[:4])
                if int(number) % 97 == 1:
                    self.take("iban", "iban", start, at, True)

    def _cue(self, start: int, end: int) -> int:
        """Where the number after a cue begins, or -1."""
        if start and self.text[start - 1].isalnum():
            return -1
        found = _after_cue(self.text, end)
        return found.end() if found else -1

    def cue_phone(self, start: int, end: int) -> None:
        at = self._cue(start, end)
        if at >= self.free.get("cue_phone", 0) and (found := _national(self.text, at)):
            self.take("cue_phone", "phone", at, found.end(), 7 <= len(_digits_of(found[0])) <= 15)

    def cue_account(self, start: int, end: int) -> None:
        at = self._cue(start, end)
        if at >= self.free.get("cue_account", 0) and (found := _account(self.text, at)):
            self.take("cue_account", "account", at, found.end(), 6 <= len(_digits_of(found[0])) <= 18)

    def cue_ssn(self, start: int, end: int) -> None:
        at = self._cue(start, end)
        if at >= 0 and (found := _ssn(self.text, at)):
            self.take("cue_ssn", "ssn", at, found.end(), True)

    def url(self, start: int, end: int) -> None:
        text, floor = self.text, self.free.get("url", 0)
        left = start
        while left > max(floor, start - 16) and text[left - 1].isascii() and (text[left - 1].isalnum() or text[left - 1] in "+-."):
            left -= 1
        if left < start and text[left].isalpha() and (found := _secret_address(text, start)):
            stop = found.end()
            while text[stop - 1] in ".,;:!?)]}":
                stop -= 1
            self.take("url", "url", left, stop, True)


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by start, kind and end; an added span inside a base one or equal to another is left out."""
    if not text:
        return []
    if not _automaton:
        _automaton.append(_anchors())
    reader = _Reader(text)
    for last, (size, parsers) in _automaton[0].iter(text):
        for parser in parsers:
            getattr(reader, parser)(last + 1 - size, last + 1)
    base = sorted(reader.base, key=lambda s: (s.start, _rank[s.kind]))
    if not reader.more:
        return base
    return sorted(base + _outside(base, set(reader.more)), key=lambda s: (s.start, _rank[s.kind], s.end))


def _outside(base: list[Span], more: set[Span]) -> list[Span]:
    """The added spans that no base span covers, found in one sweep over starts."""
    found, k, reach = [], 0, 0
    for span in sorted(more, key=lambda s: (s.start, s.end)):
        while k < len(base) and base[k].start <= span.start:
            reach = max(reach, base[k].end)
            k += 1
        if span.end > reach:
            found.append(span)
    return found


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1 << 20):
        spans = [[s._asdict() for s in find_spans(t)] for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW)], ["doc_id", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; spans are (kind, start, end, base) in the order of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_found, f"doc_id long, spans {_SPANS}")


def cover(text: str) -> str:
    """The text with [kind] for every span; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for span in find_spans(text):
        if span.start >= at:
            parts += [text[at : span.start], f"[{span.kind}]"]
        at = max(at, span.end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with every span in ``text_col`` covered; null texts stay null."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1 << 20):
            covered = pa.array([t if t is None else cover(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([covered if k == place else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    rows = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
