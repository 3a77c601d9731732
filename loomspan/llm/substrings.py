"""Removal of repeated passages by sharded Aho-Corasick automata.

A passage repeats if a window of ``WINDOW`` consecutive words starts at two places. Each window picks an anchor: the
least hash among its runs of ``GRAM`` words, the leftmost of equals. Equal windows pick equal anchors, and windows
in a row mostly share one, so a document is cut into segments (the windows of one anchor).

1. Anchors are counted over all documents (hashes only, summed in tasks before they move).
2. A bit filter of bounded size over anchors that recur goes to all tasks; segments whose anchor passes are dealt by
   anchor. A filter can let more through than recurs, never less.
3. In each shard recurring passages are confirmed word by word, compiled with pyahocorasick, and the shard's segments
   are streamed through the automaton to find every occurrence. All but the first occurrence are marked. All documents
   pass this way, but each segment meets only the automaton that can hold its passages.
   An anchor with more than ``CROWD`` segments is dealt over several shards, each with an automaton of all its windows;
   a shard marks all but its own first occurrences, and those firsts are compared by passage in a second round.
4. Marks are joined back to the documents and the marked words removed.

Defined results: words are runs of anything but ASCII white space; null, empty and short texts have no window and
keep all words; the order of occurrences is (doc_id, place of the first word), null ids first; rows that share a
doc_id count as one document, so equal rows never remove each other's words at the same place; an empty table gives an
empty table; other columns, of whatever name, stay as they are in ``remove_repeats`` and are ignored in ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomspan.llm.common import forget, materialize, slices, stream, unused

WINDOW, GRAM = 20, 8
#: Bits of the anchor filter: 16 an anchor, within these powers of two.
FILTER_MIN, FILTER_MAX = 20, 30
#: Segments of one anchor in one shard.
CROWD = 1000
#: Segments worked on at a time, characters of one automaton's patterns, and of a slice of documents.
PATTERNS, CHARS, SLICE = 2000, 1 << 18, 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_GRAM_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Words:
    """The words of several texts, one after another, with a 64-bit hash each."""

    def __init__(self, texts: list[str | None]):
        lines = [b" ".join((t or "").encode().split()) for t in texts]
        self.counts = np.array([line.count(b" ") + 1 if line else 0 for line in lines], np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.joined = b" ".join([line for line in lines if line]) + b" "
        raw = np.frombuffer(self.joined, np.uint8)
        if not self.counts.sum():
            self.starts = self.ends = np.empty(0, np.int64)
            self.hashes = np.empty(0, np.uint64)
            return
        self.ends = np.flatnonzero(raw == 32)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))
        room = 1 << max(SLICE.bit_length(), len(raw).bit_length())
        values = _byte_values()[raw] * _powers(_MULTIPLIER, room)[: len(raw)]
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
        self.hashes = mix((before[self.ends] - before[self.starts]) * _powers(_INVERSE, room)[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def text(self, first: int, end: int) -> str:
        return self.joined[self.starts[first] : self.ends[end - 1]].decode()


def segments(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first window, windows, anchor) of each segment; windows count from the first word of all texts."""
    none = np.empty(0, np.int64)
    able = np.maximum(words.counts - window + 1, 0)
    total = int(able.sum())
    if not total:
        return none, none, none, none
    h, n = words.hashes, len(words.hashes) - gram + 1
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = grams * _GRAM_MULTIPLIER + h[j : n + j]
    grams = mix(grams)
    span = window - gram + 1
    low, width = grams, 1
    while 2 * width <= span:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < span:
        low = np.minimum(low[: n - span + 1], low[span - width : n - width + 1])
    whose = np.repeat(np.arange(len(able)), able)
    at = np.arange(total) - np.repeat(np.cumsum(able) - able, able) + np.repeat(words.firsts, able)
    least = low[at]
    place = np.empty(total, np.int64)
    for j in reversed(range(span)):
        place = np.where(grams[at + j] == least, at + j, place)
    edges = np.flatnonzero(np.diff(place, prepend=-1))
    return whose[edges], at[edges], np.diff(np.append(edges, total)), grams[place[edges]].view(np.int64)


def anchor_counts(docs: DataFrame, text: str) -> DataFrame:
    """(anchor, n) of anchors with two segments at least."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        held, size = [], 0

        def flush() -> dict:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return {"anchor": found, "n": n}

        for batch in batches:
            for part in slices(batch, text, SLICE):
                held.append(segments(Words(part[text]))[3])
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return stream(docs.select(text), "anchor long, n long", rows).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")


class BitFilter:
    """Two bits a hash in a bit map of 2 ** ``power`` bits."""

    def __init__(self, power: int, words: np.ndarray):
        self.power, self.words = power, words

    @classmethod
    def of(cls, anchors: DataFrame, n: int) -> BitFilter:
        power = min(FILTER_MAX, max(FILTER_MIN, (16 * n).bit_length()))
        mask = (1 << power) - 1
        bits = anchors.select(F.explode(F.array(F.col("anchor").bitwiseAND(mask), F.shiftrightunsigned("anchor", 32).bitwiseAND(mask))).alias("bit"))
        one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
        packed = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
        words = np.zeros(1 << (power - 6), np.uint64)
        found = packed.toArrow()  # a row a word at most: 2 ** (power - 6)
        words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(power, words)

    def has(self, anchors: np.ndarray) -> np.ndarray:
        h, mask = anchors.view(np.uint64), np.uint64((1 << self.power) - 1)
        out = np.ones(len(h), bool)
        for bit in (h & mask, (h >> np.uint64(32)) & mask):
            out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def _occurrences(group: list[tuple], window: int, least: int) -> Iterator[tuple[str, int]]:
    """(pattern, words) that the segments of one anchor, (key, mark, start, windows, text), hold ``least`` times."""
    times: dict[str, int] = {}
    sizes: dict[str, int] = {}
    for *_, n, text in group:
        times[text] = times.get(text, 0) + 1
        sizes[text] = n
    if len(times) == 1 and least > 1:
        ((text, _),) = times.items()
        yield text, sizes[text] + window - 1
        return
    seen: dict[str, int] = {}
    for text, n in times.items():
        words = text.split(" ")
        for i in range(len(words) - window + 1):
            w = " ".join(words[i : i + window])
            seen[w] = seen.get(w, 0) + n
    for w, n in seen.items():
        if n >= least:
            yield w, window


def locate(groups: list[list[tuple]], window: int = WINDOW, least: int = 2) -> Iterator[tuple[str, int, list[tuple]]]:
    """(pattern, words, occurrences (key, mark, start)) of the passages of some groups, by automata of ``CHARS`` characters.

    Equal windows are in one group, so a group's segments meet the automata of its own patterns alone.
    """
    held: list[tuple[list[tuple], list[tuple[str, int]]]] = []
    size = 0
    for group in groups:
        part: list[tuple[str, int]] = []
        for pattern in _occurrences(group, window, least):
            part.append(pattern)
            size += len(pattern[0])
            if size >= CHARS:
                yield from _located([*held, (group, part)])
                held, part, size = [], [], 0
        if part:
            held.append((group, part))
    yield from _located(held)


def _located(parts: list[tuple[list[tuple], list[tuple[str, int]]]]) -> Iterator[tuple[str, int, list[tuple]]]:
    import ahocorasick

    patterns = [p for _, own in parts for p in own]
    if not patterns:
        return
    machine = ahocorasick.Automaton()
    for i, (pattern, _) in enumerate(patterns):
        machine.add_word(f" {pattern} ", i)
    machine.make_automaton()
    found: list[list[tuple]] = [[] for _ in patterns]
    for group, _ in parts:
        for key, mark, start, _, text in group:
            line = f" {text} "
            for end, i in machine.iter(line):
                begin = end + 1 - len(patterns[i][0]) - 2
                found[i].append((key, mark, start + line.count(" ", 0, begin)))
    for (pattern, n), where in zip(patterns, found, strict=True):
        yield pattern, n, where


def _order(place: tuple) -> tuple:
    key, _, start = place
    return (key is not None, key, start) if key is not None else (False, 0, start)


def _grouped(batches: Iterator[dict], by: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by key."""
    last, held = None, []
    for b in batches:
        for k, row in zip(zip(*(b[c] for c in by), strict=True), zip(*(b[c] for c in columns), strict=True), strict=True):
            if k != last:
                if held:
                    yield last, held
                last, held = k, []
            held.append(row)
    if held:
        yield last, held


def _sort_dealt(df: DataFrame, *by: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by).sortWithinPartitions(*by)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, start, words): stretches to remove. ``mark`` is the hash of the row's text."""
    spark = docs.sparkSession
    counted = materialize(anchor_counts(docs, text), "anchors")
    n, total = counted.agg(F.count("*"), F.sum("n")).first()
    kind = docs.schema[key].dataType
    marks = StructType([StructField(key, kind), *StructType.fromDDL("mark long, start int, words int").fields])
    if not n:
        return spark.createDataFrame([], marks)
    shared = spark.sparkContext.broadcast(BitFilter.of(counted, n))
    # a table of its own, so that its size decides how it is joined
    crowds = materialize(counted.filter(F.col("n") > CROWD).select("anchor", F.ceil(F.col("n") / CROWD).cast("int").alias("deals")), "crowds")
    forget(counted)

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                words = Words(part[text])
                whose, first, windows, anchor = segments(words)
                kept = np.flatnonzero(shared.value.has(anchor)) if len(anchor) else []
                whose, first, windows, anchor = (x[kept] for x in (whose, first, windows, anchor))
                yield {
                    "anchor": anchor,
                    key: [part[key][i] for i in whose],
                    "mark": [part["mark"][i] for i in whose],
                    "start": first - words.firsts[whose],
                    "windows": windows,
                    "segment": [words.text(a, a + w + WINDOW - 1) for a, w in zip(first.tolist(), windows.tolist(), strict=True)],
                }

    columns = (key, "mark", "start", "windows", "segment")
    cut_kind = StructType([*StructType.fromDDL("anchor long").fields, StructField(key, kind), *StructType.fromDDL("mark long, start int, windows int, segment string").fields])
    cuts = stream(docs.select(key, text, _mark(text).alias("mark")), cut_kind, cut)
    some = not crowds.isEmpty()
    own = F.pmod(F.xxhash64(key, "mark", "start"), "deals").cast("int")
    cuts = cuts.join(crowds, "anchor", "left").withColumn("deal", F.coalesce(own, F.lit(-1))).drop("deals") if some else cuts.withColumn("deal", F.lit(-1))
    # a first occurrence in one deal of a crowd is reported with its passage, for the second round
    out_kind = StructType([*marks.fields, StructField("passage", StringType())])

    def shard(batches: Iterator[dict]) -> Iterator[dict]:
        def run(groups: list[list[tuple]], least: int) -> Iterator[dict]:
            out: list[tuple] = []
            for pattern, n_words, where in locate(groups, least=least):
                first = min(map(_order, where))
                out += [(*place, n_words, None) for place in where if _order(place) != first]
                if least == 1:
                    out.append((*next(p for p in where if _order(p) == first), n_words, pattern))
            if out:
                yield dict(zip(out_kind.names, zip(*out, strict=True), strict=True))

        held, rows = [], 0
        for (_, deal), group in _grouped(batches, ("anchor", "deal"), columns):
            if deal >= 0:
                yield from run([group], 1)
            elif len(group) > 1:
                held.append(group)
                rows += len(group)
                if rows >= PATTERNS:
                    yield from run(held, 2)
                    held, rows = [], 0
        if held:
            yield from run(held, 2)

    found = stream(_sort_dealt(cuts, "anchor", "deal"), out_kind, shard)
    if not some:
        return found.drop("passage")
    found = materialize(found, "marks")
    firsts = found.filter("passage is not null").withColumn("place", F.struct(F.col(key).isNotNull().alias("named"), F.col(key).alias("k"), "start"))
    least_of = firsts.groupBy("passage").agg(F.min("place").alias("least"))
    # rows of one key at one place are one occurrence
    later = firsts.join(least_of, "passage").filter(F.col("place") != F.col("least")).select(*marks.names)
    return found.filter("passage is null").drop("passage").unionByName(later)


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _marked(docs: DataFrame, key: str, text: str, cuts_name: str) -> DataFrame:
    """``docs`` with the stretches to remove from each row."""
    own, of_text = unused(docs, "key"), unused(docs, "mark")
    cuts = repeats(docs.select(key, text), key, text).groupBy(F.col(key).alias(own), F.col("mark").alias(of_text))
    cuts = cuts.agg(F.collect_set(F.struct("start", "words")).alias(cuts_name))
    named = docs.withColumn(of_text, _mark(text))
    return named.join(cuts, named[key].eqNullSafe(cuts[own]) & (named[of_text] == cuts[of_text]), "left").select(*(named[c] for c in docs.columns), cuts_name)


def _kept(text: str | None, cuts: list | None) -> tuple[list[bytes], int]:
    words = (text or "").encode().split()
    if not cuts:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    place = np.array([(c["start"], c["start"] + c["words"]) for c in cuts])
    np.add.at(edge, place[:, 0], 1)
    np.add.at(edge, place[:, 1], -1)
    gone = (np.cumsum(edge)[:-1] > 0).tolist()
    return [w for w, g in zip(words, gone, strict=True) if not g], len(words)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words, joined by one space; texts without repeats stay as they are."""
    columns, place = docs.columns, unused(docs, "cuts")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            new = [t if not cuts else b" ".join(_kept(t, cuts)[0]).decode() for t, cuts in zip(batch[text], batch[place], strict=True)]
            yield {c: batch[c] for c in columns} | {text: new}

    return stream(_marked(docs, key, text, place), docs.schema, rows)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            made = [_kept(t, cuts) for t, cuts in zip(batch[text], batch["cuts"], strict=True)]
            yield {
                key: batch[key],
                "n_words": [n for _, n in made],
                "n_removed": [n - len(k) for k, n in made],
                "kept_sha256": [hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in made],
            }

    kind = StructType([docs.schema[key], *StructType.fromDDL("n_words long, n_removed long, kept_sha256 string").fields])
    return stream(_marked(docs.select(key, text), key, text, "cuts"), kind, rows)
