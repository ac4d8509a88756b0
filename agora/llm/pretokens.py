"""Pre-tokens of a byte-level vocabulary, and a bounded memory of what they encode to."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# The pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 250_000

# The same for texts of ASCII and Latin letters alone, for the faster engine.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_other = re.compile(rf"[^\t\n\r -~{_LATIN}]").search
_latin = re.compile(rf" ?[{_LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+").findall
_any = regex.compile(PATTERN).findall


def pre_tokens(text: str) -> list[str]:
    return _any(text) if _other(text) else _latin(text)


class WordMemory:
    """Encodings by word in two generations: when the young one is full the old one goes.

    A word used again moves to the young one, so frequent words stay.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = KEPT_WORDS) -> None:
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _again(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self.young[word] = found
        return found

    def joined(self, words: list[str]) -> bytes:
        """The encodings of all words, end to end; none of them is empty."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        get, again = self.young.get, self._again
        return b"".join([get(w) or again(w) for w in words])
