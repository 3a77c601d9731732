"""Benchmark decontamination through a positional inverted index over the training documents.

The index is stored in the shared folder: a table of segments and one of term counts. A segment covers some documents
and holds, for each term in them, the ascending positions at which it stands; documents follow each other in one
position space with gaps, so a position names a document and a word of it. The index knows nothing of the test items
and can be searched for any. Segments are written by one pass and never change, as rows of Parquet, so a lost executor
costs its tasks alone.

A query window is answered inside each segment that holds its rarest term (by counts over all segments): its lists are
taken from the rarest term on, shifted by the term's offset and intersected; most windows end at the first empty list.
Allowing a ``slop`` keeps a start if each term stands within that many places of its own, so the same lists give exact
phrases (slop 0) and proximity matches. Windows go to the segments in blocks of ``BLOCK_WINDOWS``, and the driver holds
one block at a time.

Defined results: null and empty texts have no words and no hit; an item with fewer words than a window is one window,
an item of none has no window; repeated items count each under its own id; equal item rows count once; null item ids
are left out of the item list but their windows still hit; repeated rows and null keys each have their row; an empty
table gives an empty table; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import batched, count

import numpy as np
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loomspan.llm.common import materialize, slices, stream

WINDOW = 10
#: Characters of text a segment covers, places between two documents, and query windows a pass over the segments takes.
SEGMENT_CHARS, GAP, BLOCK_WINDOWS = 2 << 20, 1024, 200_000
#: Terms that a task counts before it sends them on.
MOST_TERMS = 500_000
#: ASCII letters and digits and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

FOUND = "seg long, place int, n_words long, starts array<long>, sizes array<long>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, lower-cased in ASCII."""
    return WORD.findall((text or "").encode().lower())


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


@dataclass(frozen=True)
class Index:
    """Tables of a stored index: segments (seg, keys, lengths, terms, counts, steps) and counts (term, n)."""

    segments: DataFrame
    counts: DataFrame


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> Index:
    """Index ``docs`` below ``path``, or below a scratch path.

    The terms of a segment are in ascending order; their positions, one term's after another's, are kept as steps from
    the position before (the first of each term from 0).
    """
    tail = StructType.fromDDL("lengths binary, terms binary, counts binary, steps binary").fields
    kind = StructType([StructField("seg", LongType()), StructField("keys", ArrayType(docs.schema[key].dataType)), *tail])

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text, SEGMENT_CHARS):
                code_of: dict[bytes, int] = defaultdict(count().__next__)
                codes = [np.array(list(map(code_of.__getitem__, words_of(t))), np.int32) for t in part[text]]
                lengths = np.fromiter(map(len, codes), np.int64, len(codes))
                names = sorted(code_of)
                rank = np.empty(len(names), np.int32)
                rank[[code_of[t] for t in names]] = np.arange(len(names))
                code = rank[np.concatenate(codes)]
                order = np.argsort(code, kind="stable")
                where = (np.arange(len(code)) + GAP * np.repeat(np.arange(len(codes)), lengths))[order]
                held = np.bincount(code, minlength=len(names))
                steps = np.diff(where, prepend=0)
                firsts = np.cumsum(held) - held
                steps[firsts] = where[firsts]
                yield {"seg": [seg], "keys": [part[key]], "lengths": [lengths.tobytes()], "terms": [b"\n".join(names)], "counts": [held.astype("<u4").tobytes()], "steps": [steps.astype("<u4").tobytes()]}
                seg += 1

    made = stream(docs.select(key, text), kind, rows)
    if path:
        made.write.parquet(f"{path}/segments")
        segments = docs.sparkSession.read.schema(kind).parquet(f"{path}/segments")
    else:
        segments = materialize(made, "segments")

    def terms(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[str, int] = defaultdict(int)

        def flush() -> Iterator[dict]:
            for part in batched(held.items(), 50_000):
                yield dict(zip(("term", "n"), zip(*part, strict=True), strict=True))
            held.clear()

        for batch in batches:
            for names, n in zip(batch["terms"], batch["counts"], strict=True):
                if n:
                    for t, c in zip(names.decode().split("\n"), np.frombuffer(n, "<u4").tolist(), strict=True):
                        held[t] += c
                if len(held) > MOST_TERMS:
                    yield from flush()
        yield from flush()

    counted = stream(segments.select("terms", "counts"), "term string, n long", terms).groupBy("term").agg(F.sum("n").alias("n"))
    if path:
        counted.write.parquet(f"{path}/counts")
        return Index(segments, docs.sparkSession.read.schema(counted.schema).parquet(f"{path}/counts"))
    return Index(segments, materialize(counted, "counts"))


def term_counts(index: Index, terms: set[bytes]) -> dict[bytes, int]:
    """Occurrences of each of ``terms`` (those of one block of windows) that the index has."""
    spark = index.counts.sparkSession
    asked = spark.createDataFrame([(t.decode(),) for t in sorted(terms)], "term string")
    return {r.term.encode(): r.n for r in index.counts.join(asked, "term", "left_semi").collect()}


def _near(starts: np.ndarray, shifted: np.ndarray, slop: int) -> np.ndarray:
    """Starts with an entry of the ascending ``shifted`` within ``slop`` places."""
    if not len(shifted):
        return starts[:0]
    i = np.searchsorted(shifted, starts - slop)
    return starts[(i < len(shifted)) & (shifted[np.minimum(i, len(shifted) - 1)] <= starts + slop)]


def match(lists: dict[bytes, np.ndarray], query: list[tuple[int, bytes]], slop: int = 0) -> np.ndarray:
    """Starts of a window in a segment; ``query`` has (offset, term) from the rarest term on."""
    offset, term = query[0]
    found = lists.get(term)
    if found is None:
        return np.empty(0, np.int64)
    starts = np.unique(np.concatenate([found - offset + d for d in range(-slop, slop + 1)])) if slop else found - offset
    for offset, term in query[1:]:
        other = lists.get(term)
        if other is None:
            return starts[:0]
        starts = _near(starts, other - offset, slop)
        if not len(starts):
            break
    return starts


def _blocks(items: DataFrame, size: int) -> Iterator[dict[tuple[bytes, ...], list]]:
    """Windows with the ids of their items, ``BLOCK_WINDOWS`` at most at a time."""
    windows: dict[tuple[bytes, ...], list] = {}
    for r in items.toLocalIterator():
        for w in dict.fromkeys(windows_of(words_of(r.t), size)):
            held = windows.setdefault(w, [])
            if r.id is not None:
                held.append(r.id)
            if len(windows) >= BLOCK_WINDOWS:
                yield windows
                windows = {}
    if windows:
        yield windows


def _plan(index: Index, windows: dict[tuple[bytes, ...], list]) -> dict[bytes, list]:
    """Windows by their rarest term, each with its terms from the rarest on; those with an unknown term find nothing."""
    counts, plan = term_counts(index, {w for x in windows for w in x}), {}
    for words, items in windows.items():
        if all(w in counts for w in words):
            query = sorted(enumerate(words), key=lambda x: (counts[x[1]], x))
            plan.setdefault(query[0][1], []).append((query, len(words), items))
    return plan


def search(index: Index, items: DataFrame, size: int = WINDOW, slop: int = 0, report: tuple[StructType, Callable[[dict], dict]] | None = None) -> DataFrame:
    """Per document: key, n_words, starts and sizes of the windows in it, and items: the ids of those of ``items`` (id, t).

    Starts count from the document's first word. ``size`` and ``slop`` together are below the gap between documents.
    ``report``: a schema, and what makes its columns from a batch of these. Windows of one block are reported as they
    are found: a second stream in the same task would be a second Python worker, which an executor then keeps.
    """
    if size + slop >= GAP:
        raise ValueError(f"windows of {size} words and a slop of {slop} reach over the gap of {GAP}")
    spark = index.segments.sparkSession
    kind = StructType([StructField("key", index.segments.schema["keys"].dataType.elementType), *StructType.fromDDL(FOUND).fields])

    def sent(plan: dict[bytes, list]) -> Broadcast:
        return spark.sparkContext.broadcast((plan, frozenset(t for queries in plan.values() for q, *_ in queries for _, t in q)))

    def answered(shared: Broadcast, kind: StructType, made: Callable[[dict], dict]) -> DataFrame:
        def one(names: bytes, held: bytes, steps: bytes, lengths: bytes) -> tuple[list, list, list, list]:
            plan, asked = shared.value
            sizes_of = np.frombuffer(lengths, np.int64)
            ends = np.cumsum(np.frombuffer(held, "<u4").astype(np.int64)).tolist()
            step, lists = np.frombuffer(steps, "<u4"), {}
            for i, t in enumerate(names.split(b"\n")):
                if t in asked:
                    lists[t] = np.cumsum(step[ends[i - 1] if i else 0 : ends[i]].astype(np.int64))
            last = np.cumsum(sizes_of + GAP)
            first = last - sizes_of - GAP
            starts, sizes, found = ([[] for _ in sizes_of] for _ in range(3))
            for t in lists.keys() & plan.keys():
                for query, n, ids in plan[t]:
                    for p in match(lists, query, slop).tolist():
                        # with a slop a start may lie before its document
                        d = int(np.searchsorted(last - GAP + slop, p, "right"))
                        starts[d].append(p - int(first[d]))
                        sizes[d].append(n)
                        found[d].extend(ids)
            return sizes_of.tolist(), starts, sizes, [list(dict.fromkeys(x)) for x in found]

        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                for seg, keys, *held in zip(*(batch[c] for c in ("seg", "keys", "terms", "counts", "steps", "lengths")), strict=True):
                    n_words, starts, sizes, found = one(*held)
                    yield made({"key": keys, "seg": [seg] * len(keys), "place": list(range(len(keys))), "n_words": n_words, "starts": starts, "sizes": sizes, "items": found})

        return stream(index.segments, kind, rows)

    blocks = [sent(_plan(index, windows)) for windows in _blocks(items, size)] or [sent({})]
    if report and len(blocks) == 1:
        return answered(blocks[0], *report)
    out, *more = (answered(shared, kind, dict) for shared in blocks)
    for part in more:
        out = out.unionByName(part)
    if more:
        flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "sizes")]
        out = out.groupBy("key", "seg", "place", "n_words").agg(*flat, F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = out.drop("seg", "place")
    return stream(out, report[0], lambda batches: map(report[1], batches)) if report else out


def _hits(key: str, b: dict) -> dict:
    """The columns of ``contamination`` from a batch of ``search``."""
    hits = []
    for n, starts, sizes in zip(b["n_words"], b["starts"], b["sizes"], strict=True):
        if not starts:
            hits.append(0)
            continue
        edge = np.zeros(n + 1, np.int64)
        s = np.array(starts)
        np.add.at(edge, np.clip(s, 0, n), 1)
        np.add.at(edge, np.clip(s + np.array(sizes), 0, n), -1)
        hits.append(int((np.cumsum(edge) > 0).sum()))
    return {
        key: b["key"],
        "n_words": b["n_words"],
        "n_hit": hits,
        "n_items": [len(x) for x in b["items"]],
        "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in b["items"]],
        "contaminated": [h > 0 for h in hits],
    }


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 0, index: Index | None = None) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated; ``index``: of ``docs``, if there is one."""
    asked = items.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("t")).distinct()
    tail = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    kind = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL(tail).fields])
    return search(index or build_index(docs, key, text), asked, size, slop, (kind, partial(_hits, key)))
