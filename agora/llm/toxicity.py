"""Toxicity scores: a weighted lexicon matched by Aho-Corasick in folded texts.

Folding undoes disguises: letters that look alike or have other widths, case, and digits or
signs inside a word that stand for letters.  The lexicon holds beginnings of words
and whole words with weights, learned from labelled documents: terms are taken one
after the other, each time the one that explains most toxic documents not yet
explained, less its share of the others.  Phrases found around a term in
harmless documents alone, and given ones, are exceptions: a match inside one does
not count.  The score is a logistic function of the weighted hits, of the hits by
length, and of the number of different terms.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import by_bytes, table, texts_of
from agora.llm.labelled import held_out, sample

TRAIN_ROWS = 8_000
PARTS, PART = 3, 1
THRESHOLD = 0.7
SHORTEST, LONGEST = 4, 14
COVER = 4
# Harmless phrases with words that are insults alone.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "sore loser", "stupid question")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁѵԛԝɡαβεικνορτυχωɑıʟ" "ɩⅼ",
    "abekmhopctyxijsdvqwgabeikvoptuxwail" "il",
)
# Digits and signs that stand for letters inside a word.
STANDS_FOR = str.maketrans("0134578@$!|", "oieastbasil")
_disguised = re.compile(r"(?<![\w@$!|])[@$!|0-9]+(?=[^\W\d_])|(?<=[^\W\d_])[@$!|0-9]+(?=[^\W\d_])").sub
_letters = re.compile(r"[^\W\d_]+").findall


def fold(text: str) -> str:
    """Lower-case words without disguises, each between single blanks."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(LOOKALIKES)
    text = _disguised(lambda m: m[0].translate(STANDS_FOR), text)
    return " " + " ".join(_letters(text)) + " "


def starts_of(word: str) -> list[str]:
    """The terms a word could be an instance of: its beginnings, and itself whole."""
    return [" " + word + " "] * (len(word) >= 3) + [" " + word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)]


@dataclass
class Lexicon:
    """Terms with weights, exceptions, and the logistic coefficients."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    logistic: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The automaton of a lexicon; terms and exceptions are found in one pass."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(term, (len(term), weight, term))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None, phrase))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.logistic = lexicon.logistic

    def hits(self, folded: str) -> list[tuple[str, float]]:
        """(term, weight) of one hit for every word that has any, the heaviest, exceptions left out."""
        if not len(self.automaton):
            return []
        free: list[tuple[int, int]] = []
        found: dict[int, tuple[str, float]] = {}
        for end, (size, weight, term) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            elif start not in found or weight > found[start][1]:
                found[start] = (term, weight)
        if free:
            for start in [s for s in found if any(a <= s < b for a, b in free)]:
                del found[start]
        return list(found.values())

    def measures(self, folded: str) -> np.ndarray:
        hits = self.hits(folded)
        total = sum(w for _, w in hits)
        words = max(1, folded.count(" ") - 1)
        return np.array([1.0, np.log1p(total), np.log1p(100 * total / (words + 20)), np.log1p(len({t for t, _ in hits}))])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.measures(fold(text)) @ self.logistic))))


def _choose(toxic: list[set[str]], harmless: list[set[str]], least: int) -> dict[str, float]:
    """Terms and weights by greedy covering; a document counts until ``COVER`` terms explain it."""
    found: dict[str, set[int]] = defaultdict(set)
    for k, terms in enumerate(toxic):
        for term in terms:
            found[term].add(k)
    found = {t: ks for t, ks in found.items() if len(ks) >= least}
    against = Counter()
    for terms in harmless:
        against.update(t for t in terms if t in found)
    ratio = max(1, len(harmless)) / max(1, len(toxic))
    able = {t: ks for t, ks in found.items() if against[t] <= 0.35 * ratio * len(ks)}
    left = np.full(len(toxic), COVER)
    chosen: dict[str, float] = {}
    while able:
        gain = {t: sum(1 for k in ks if left[k] > 0) - 2 * against[t] / ratio for t, ks in able.items()}
        able = {t: ks for t, ks in able.items() if gain[t] >= least}
        if not able:
            break
        best = max(able, key=lambda t: (gain[t], len(t), t))
        chosen[best] = float(np.log((len(able[best]) + 0.5) * ratio / (against[best] + 0.5)))
        # Longer and shorter forms of a chosen term say nothing new.
        same = able.pop(best)
        stem = best.strip()
        for t in [t for t in able if t.strip().startswith(stem) or stem.startswith(t.strip())]:
            del able[t]
        left[list(same)] -= 1
    return {t: w for t, w in chosen.items() if w > 0}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    keep = np.diag([0.0] + [ridge] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_lexicon(rows: list[tuple[str, int]], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn a lexicon; without examples of both kinds it is empty and scores are low."""
    rows = list(dict.fromkeys(rows))  # copies of a text say nothing more
    folded = [(fold(t), y) for t, y in rows]
    labels = np.array([y for _, y in folded], dtype=float)
    if not len(labels) or labels.min() == labels.max():
        return Lexicon({})
    terms_of: dict[str, list[str]] = {}
    toxic, harmless = [], []
    wanted: Counter[str] = Counter()
    for text, y in folded:
        if y:
            terms = {s for w in set(text.split()) for s in terms_of.setdefault(w, starts_of(w))}
            toxic.append(terms)
            wanted.update(terms)
    least = max(3, len(toxic) // 150)
    common = {t for t, c in wanted.items() if c >= least}
    toxic = [terms & common for terms in toxic]
    able_of: dict[str, list[str]] = {}
    for text, y in folded:
        if not y:
            terms: set[str] = set()
            for w in set(text.split()):
                if w not in able_of:
                    able_of[w] = [s for s in starts_of(w) if s in common]
                terms.update(able_of[w])
            harmless.append(terms)
    weights = _choose(toxic, harmless, least)
    free = {fold(p) for p in exceptions} | _harmless_phrases(folded, Lexicon(weights).matcher(), least)
    lexicon = Lexicon(weights, frozenset(free))
    matcher = lexicon.matcher()
    lexicon.logistic = _logistic(np.stack([matcher.measures(t) for t, _ in folded]), labels)
    return lexicon


def _harmless_phrases(folded: list[tuple[str, int]], matcher: Matcher, least: int) -> set[str]:
    """Pairs of words with a hit that ``least`` harmless documents have and no toxic one."""
    seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for text, y in folded:
        hits = {t for t, _ in matcher.hits(text)}
        if not hits:
            continue
        words = text.split()
        marked = [any((" " + w + " ").startswith(t) for t in hits) for w in words]
        pairs = {f" {a} {b} " for a, b, m, n in zip(words, words[1:], marked, marked[1:], strict=False) if m or n}
        seen[y].update(pairs)
    return {p for p, c in seen[0].items() if c >= least and not seen[1][p]}


_loaded: list[tuple[object, Matcher]] = []


def _matcher(lexicon: Lexicon) -> Matcher:
    if not _loaded or _loaded[0][0] is not lexicon:
        _loaded[:] = [(lexicon, lexicon.matcher())]
    return _loaded[0][1]


def _scores(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(lexicon)
        for batch in by_bytes(batches):
            scores = [matcher.score(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null counts as empty, repeated rows are kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scores(lexicon), "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = fit_lexicon(sample(docs, labels, "toxic", PARTS, PART, TRAIN_ROWS))
    return score(docs, lexicon).select(
        "doc_id", held_out("doc_id", PARTS, PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
