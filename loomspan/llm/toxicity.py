"""Toxicity by a counterfactual-regularised linear classifier.

Texts are sets of words and of the first 4, 5 and 6 letters of longer words, hashed. Features that differ between the
classes beyond chance, and those of identity terms, are kept and a logistic model is fitted on a bounded sample of
labelled rows. In each labelled sentence that holds an identity term, the term is swapped for others of its kind; the
squared change of the score under the swap is penalised, so a mention says no more than another of its kind would, and
words that carry the label alone do.

Identity terms are a fixed seed list and terms learned from the sample, in any language: words that both classes use
about as often as chance allows. Their kinds are the words that stand in the same frames (the word before and the
word after), whatever the label.

Documents are scored in one pass over whole texts without moving them.

Defined results: null and empty texts have no feature and get the score of the bias alone; letters are lower-cased;
repeats of a word count once; rows that repeat are scored each; a null key has a score like any other; an empty table
gives an empty table; other columns stay as they are, and an output name that is taken is refused (``unused`` finds
another); without labelled rows of both classes the score is the share of label 1 among the labelled rows, or 0
without any.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.llm.common import forget, materialize, slices, stream, unused
from loomspan.llm.labelled import SAMPLE, is_held_out, sample

THRESHOLD = 0.7
#: Terms that name groups of people, by kind.
IDENTITY = (
    ("man", "woman", "men", "women", "male", "female", "boys", "girls"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "indian", "arab"),
    ("american", "mexican", "chinese", "russian", "german", "french", "spanish", "japanese"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
    ("immigrant", "refugee", "migrant", "foreigner", "native"),
)
#: Hash range of features, and weight of the two penalties.
RANGE, RIDGE, SWAP = 1 << 22, 3e-5, 1.0
#: Deviations beyond which a feature is more than chance, and rows it must be in: three, or one in this many.
DEVIATION, ROWS = 4.5, 2000
#: Learned terms: the most frequent words whose classes differ by fewer deviations than NEUTRAL, and terms of a kind.
TERMS, NEUTRAL, KIND = 200, 2.0, 4
#: Characters of texts at work at a time, and words whose features a task remembers.
SLICE, KNOWN = 1 << 20, 100_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    return [zlib.crc32(x.encode()) % RANGE for x in (f"={word}", *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n))]


def kinds(identity=IDENTITY) -> dict[str, tuple[str, ...]]:
    """The terms that may stand for each identity term."""
    return {t: tuple(x for x in kind if x != t) for kind in identity for t in kind}


def swaps(words: set[str], others: dict[str, tuple[str, ...]], features_of: Callable[[str], tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(features gone, features come) when one identity term of a sentence's words is swapped for another of its kind.

    A feature that other words of the sentence hold as well neither goes nor comes.
    """
    terms = words & others.keys()
    if not terms:
        return
    held = Counter(f for w in words for f in features_of(w))
    for term in sorted(terms):
        own = features_of(term)
        gone = {f for f in own if held[f] == 1}
        for other in others[term]:
            if other not in words:
                come = {f for f in features_of(other) if not held[f] or f in gone}
                if gone != come:
                    yield tuple(sorted(gone - come)), tuple(sorted(come - gone))


def learn_kinds(rows_: DataFrame, text: str, terms: list[str]) -> dict[str, tuple[str, ...]]:
    """For each of ``terms`` the ``KIND`` others that share most frames with it in the texts of ``rows_``."""
    known = frozenset(terms)

    def frames(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                found = {(a, c, b) for t in part[text] for s in _SENTENCE.split(t.lower()) for a, b, c in _triples(_WORD.findall(s)) if b in known}
                if found:
                    yield {"frame": [zlib.crc32(f"{a} {c}".encode()) for a, c, _ in found], "term": [b for *_, b in found]}

    uses = stream(rows_.select(text), "frame long, term string", frames).groupBy("frame").agg(F.collect_set("term").alias("terms"))
    # a frame holds ``TERMS`` different terms at most
    pair = uses.filter(F.size("terms") > 1).select("terms", F.explode("terms").alias("a")).select("a", F.explode("terms").alias("b")).filter("a <> b")
    shared: dict[str, list] = {}
    for r in pair.groupBy("a", "b").count().collect():  # TERMS * TERMS rows at most
        shared.setdefault(r.a, []).append((-r["count"], r.b))
    return {t: tuple(b for _, b in sorted(found)[:KIND]) for t, found in sorted(shared.items())}


def _triples(words: list[str]) -> Iterator[tuple[str, str, str]]:
    return zip(words, words[1:], words[2:], strict=False)


class Classifier:
    """Weights by hashed feature."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        return tuple(f for f in features(word) if f in self.weights)

    def logit(self, text: str | None) -> float:
        words = set(_WORD.findall((text or "").lower()))
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in words.difference(known):
            known[w] = self._of(w)
        found = {f for fs in map(known.__getitem__, words) if fs for f in fs}
        return self.bias + sum(map(self.weights.__getitem__, sorted(found)))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


def choose(ids: np.ndarray, every: np.ndarray, ones: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Features that differ between the classes beyond chance; ``every``, ``ones``: rows with each."""
    return np.sort(ids[deviations(every, ones, n, n1) >= DEVIATION])


def deviations(every: np.ndarray, ones: np.ndarray, n: int, n1: int) -> np.ndarray:
    """By how many deviations the shares of rows of the two classes differ."""
    share = every / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / (n - n1)))
    return np.abs((ones / n1 - (every - ones) / (n - n1)) / spread)


def fit(kept: np.ndarray, rows: tuple[np.ndarray, np.ndarray], labels: np.ndarray, pairs: list[tuple[list[int], list[int], int]], swap: float = SWAP, steps: int = 600) -> Classifier:
    """A classifier from the places in ``kept`` of the rows' features (row and place of each), labels, and swaps.

    A swap is the places of the features that it takes and brings, and how many sentences it stands for.
    """
    n, n1, k = len(labels), int(labels.sum()), len(kept)
    if not n1 or n1 == n or not k:
        share = n1 / n if n else 0.0
        return Classifier({}, float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    where, at = rows
    moved = [(i, f, s) for i, (gone, come, _) in enumerate(pairs) for fs, s in ((gone, 1.0), (come, -1.0)) for f in fs]
    pair, pat, sign = (np.array([m[j] for m in moved], kind) for j, kind in enumerate((np.int64, np.int64, np.float64)))
    times = np.array([m for *_, m in pairs], np.float64)
    times /= max(times.sum(), 1.0)
    # accelerated gradient steps scaled by each feature's own curvature
    curve = np.bincount(at, minlength=k) / (4 * n) * max(1.0, np.bincount(where, minlength=n).max()) ** 0.5 + RIDGE
    if pairs:
        curve += 2 * swap * np.bincount(pat, times[pair], minlength=k) * np.bincount(pair).max()
    w, bias, t = np.zeros(k), float(np.log(n1 / (n - n1))), 1.0
    ahead, bias_ahead = w, bias
    for _ in range(steps):
        z = bias_ahead + np.bincount(where, ahead[at], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        slope = np.bincount(at, error[where], minlength=k) / n + RIDGE * ahead
        if pairs:
            change = np.bincount(pair, sign * ahead[pat], minlength=len(pairs)) * times
            slope += 2 * swap * np.bincount(pat, sign * change[pair], minlength=k)
        new, new_bias = ahead - slope / curve, bias_ahead - error.mean() / 0.25
        t_new = 1.0 if (slope * (new - w)).sum() > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return Classifier({int(f): float(x) for f, x in zip(kept, w, strict=True) if abs(x) > 1e-6}, float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = SAMPLE, identity=IDENTITY, swap: float = SWAP) -> Classifier:
    """Fitted on labelled rows that are not held out; tasks count features and send the kept ones, not texts."""
    rows_ = materialize(sample(docs, labels, label, key, text, most), "labelled")
    n, n1 = rows_.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n1 or n1 == n:
        none = np.empty(0, np.int64)
        return fit(none, (none, none), np.full(n, 1 if n1 else 0), [])

    def of(words: set[str]) -> set[int]:
        return {f for w in words for f in features(w)}

    least = F.col("n") >= max(3, n // ROWS)

    def summed(counted: DataFrame) -> DataFrame:
        return counted.groupBy("f").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).filter(least)

    def features_in(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                sets = [of(set(_WORD.findall(t.lower()))) for t in part[text]]
                flat = np.fromiter((f for s in sets for f in s), np.int64, sum(map(len, sets)))
                found, back = np.unique(flat, return_inverse=True)
                label_of = np.repeat(np.array(part["label"]), [len(s) for s in sets])
                yield {"f": found, "n": np.bincount(back), "ones": np.bincount(back, label_of).astype(np.int64)}

    def words_in(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                every, ones = Counter(), Counter()
                for t, y in zip(part[text], part["label"], strict=True):
                    every.update(found := set(_WORD.findall(t.lower())))
                    if y:
                        ones.update(found)
                yield {"f": list(every), "n": list(every.values()), "ones": [ones[f] for f in every]}

    source = rows_.select(text, "label")
    got = summed(stream(source, "f long, n long, ones long", features_in)).toArrow()
    kept = choose(*(got[c].to_numpy() for c in ("f", "n", "ones")), n, n1)
    others = kinds(identity)
    if swap:
        found = summed(stream(source, "f string, n long, ones long", words_in)).orderBy(F.desc("n"), "f").limit(10 * TERMS).toArrow()
        even = deviations(found["n"].to_numpy(), found["ones"].to_numpy(), n, n1) < NEUTRAL
        terms = [w for w, e in zip(found["f"].to_pylist(), even, strict=True) if e][:TERMS]
        others = learn_kinds(rows_, text, terms) | others
        kept = np.unique(np.concatenate((kept, np.array([f for w in terms for f in features(w)[:1]], np.int64))))
    shared = docs.sparkSession.sparkContext.broadcast(({int(f): i for i, f in enumerate(kept)}, others))

    def placer() -> Callable[[str], tuple[int, ...]]:
        """Places of a word's kept features; ``KNOWN`` words are remembered at a time."""
        place = shared.value[0]

        @lru_cache(maxsize=KNOWN)
        def find(word: str) -> tuple[int, ...]:
            return tuple({place[f] for f in features(word) if f in place})

        return find

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        find = placer()
        for batch in batches:
            for part in slices(batch, text, SLICE):
                own = [sorted({p for w in set(_WORD.findall(t.lower())) for p in find(w)}) for t in part[text]]
                yield {"key": [repr(k) for k in part[key]], "label": part["label"], "own": own}

    def changes(batches: Iterator[dict]) -> Iterator[dict]:
        find, others = placer(), shared.value[1]
        for batch in batches:
            for part in slices(batch, text, SLICE):
                seen: Counter[tuple] = Counter()
                for t in part[text]:
                    for s in _SENTENCE.split(t.lower()):
                        seen.update(swaps(set(_WORD.findall(s)), others, find))
                yield {"gone": [list(g) for g, _ in seen], "come": [list(c) for _, c in seen], "n": list(seen.values())}

    made = stream(rows_, "key string, label int, own array<int>", rows).toArrow().combine_chunks().sort_by("key")  # tasks end in any order
    own = made["own"].combine_chunks() if made.num_rows else pa.array([], pa.list_(pa.int32()))
    sizes = own.value_lengths().to_numpy()
    at = own.flatten().to_numpy().astype(np.int64)
    pairs = []
    if swap and others:
        # few swaps differ: terms have few features, so their number does not follow the number of sentences
        swapped = stream(rows_.select(text), "gone array<int>, come array<int>, n long", changes).groupBy("gone", "come").agg(F.sum("n").alias("n"))
        pairs = sorted((r.gone, r.come, r.n) for r in swapped.collect())
    forget(rows_)
    return fit(kept, (np.repeat(np.arange(len(sizes)), sizes), at), made["label"].to_numpy(), pairs, swap)


def predict(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on)."""
    if clash := {score.lower(), predicted.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns already there: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # features of a bounded sample

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        own = Classifier(*shared.value)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                found = [own.score(t) for t in part[text]]
                yield part | {score: found, predicted: [int(s >= threshold) for s in found]}

    return stream(docs, StructType([*docs.schema.fields, *StructType.fromDDL(f"`{score}` double, `{predicted}` int").fields]), rows)


def harmless(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with the columns they came with."""
    names = unused(docs, "score"), unused(docs, "predicted")
    return predict(docs, model, key, text, score=names[0], predicted=names[1]).filter(F.col(names[1]) == 0).drop(*names)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    scored = predict(docs.select(key, text), train(docs, labels, key=key, text=text), key, text)
    return scored.select(key, is_held_out(key).alias("held_out"), F.col("score"), F.col("predicted"))
