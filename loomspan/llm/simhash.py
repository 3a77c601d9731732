"""SimHash near-duplicates: fingerprints, bit-sliced comparison and connected components.

Fingerprints that differ in at most ``RADIUS`` of 64 bits are linked. Equal fingerprints are first folded into one
row. The 64 bits fall into 5 bands; two linked fingerprints agree in 2 whole bands at least, so each fingerprint
goes under the 10 keys of two bands and only those under one key are compared. There fingerprints lie in blocks of
bit planes: plane b holds bit b of all lanes of the block. A query's differences are planes or their complements;
carry-save counters add them lane by lane, and once a counter exceeds the radius its lane is dropped; a block is
abandoned when no lane is left; blocks whose lanes and queries are all joined already are passed over. A key with more
than ``CROWD`` fingerprints is dealt over pairs of blocks, one pair a task's work. What a task yields is a forest:
each fingerprint linked there points to the smallest one it reaches in that group, never all pairs.

Components come from alternating large-star and small-star rounds on tables in the shared folder, until the links are
stars.

Defined results: null and empty text have no shingle and fingerprint zero, linked like any other; fewer words than
a shingle make one shingle of all; repeats count; rows that share a key column value are rows of their own; a null
key never becomes a component id where another key is there; an empty table gives an empty table; other columns, of
whatever name, are ignored, and kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomspan.llm.common import forget, materialize, slices, stream, unused
from loomspan.operators.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: First bit and width of each band.
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = list(combinations(range(5), 2))
#: Lanes of a block, fingerprints of a group that shares its block with others, and fingerprints of one key in a task.
LANES, PACKED, CROWD = 4096, 256, 4096


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: 1 - words].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mark (hash of the text) and fp (the fingerprint as a signed 64-bit number)."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, text):
                found = np.array([fingerprint(shingle_hashes(t)) for t in part[text]], np.uint64)
                yield {key: part[key], "mark": part["mark"], "fp": found.view(np.int64)}

    kind = StructType([df.schema[key], StructField("mark", LongType()), StructField("fp", LongType())])
    return stream(df.select(key, text, _mark(text).alias("mark")), kind, rows)


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Block:
    """Bit planes of fingerprints, 64 lanes a word; a fingerprint is one or more 64-bit words."""

    def __init__(self, fps: np.ndarray):
        fps = fps.reshape(len(fps), -1)
        self.n, self.bits = len(fps), 64 * fps.shape[1]
        bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8), axis=1, bitorder="little")
        lanes = np.zeros((self.bits, -(-self.n // 64) * 64), np.uint8)
        lanes[:, : self.n] = bits.T
        self.planes = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)
        room = np.zeros(lanes.shape[1], np.uint8)
        room[: self.n] = 1
        self.real = np.packbits(room, bitorder="little").view(np.uint64)

    def within(self, queries: np.ndarray, radius: int = RADIUS, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, lane) pairs at ``radius`` or less, for many queries at once; ``asked``: lanes that each query asks for."""
        queries = queries.reshape(len(queries), -1)
        who = np.arange(len(queries))
        live = np.broadcast_to(self.real, (len(queries), len(self.real))).copy()
        if asked is not None:
            live &= np.packbits(np.pad(asked, ((0, 0), (0, 64 * len(self.real) - self.n))), axis=1, bitorder="little").view(np.uint64)
            who = np.flatnonzero(live.any(axis=1))
            live = live[who]
        digits = [np.zeros_like(live) for _ in range(radius.bit_length())]
        for bit in range(self.bits):
            if not len(who):
                break
            flip = np.where((queries[who, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 1, ~np.uint64(0), np.uint64(0))
            carry = self.planes[bit][None] ^ flip[:, None]
            for d in digits:
                new = d & carry
                d ^= carry
                carry = new
            live &= ~carry  # a counter that overflows its digits is beyond the radius
            if bit % 8 == 7:
                live &= ~self._over(digits, radius)
                keep = live.any(axis=1)
                if not keep.all():
                    who, live, digits = who[keep], live[keep], [d[keep] for d in digits]
        row, lane = np.nonzero(np.unpackbits(live.view(np.uint8), axis=1, bitorder="little"))
        return who[row], lane

    @staticmethod
    def _over(digits: list[np.ndarray], radius: int) -> np.ndarray:
        """Lanes whose counter is greater than the radius, compared digit by digit."""
        over, equal = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
        for i in reversed(range(len(digits))):
            if radius >> i & 1:
                equal &= digits[i]
            else:
                over |= equal & digits[i]
                equal &= ~digits[i]
        return over


class Forest:
    """Disjoint sets of places; the top of a set is its smallest place."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def tops(self) -> np.ndarray:
        while (self.up != (up := self.up[self.up])).any():
            self.up = up
        return self.up

    def top(self, i: int) -> int:
        return int(self.tops()[i])

    def join(self, i: np.ndarray | int, j: np.ndarray | int) -> None:
        """Join the sets of i and j, pair by pair."""
        i, j = np.atleast_1d(i), np.atleast_1d(j)
        while True:
            a, b = (up := self.tops())[i], up[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            self.up = up.copy()
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _compare(fps: np.ndarray, at: np.ndarray, forest: Forest, radius: int = RADIUS) -> None:
    """Join the places ``at`` whose fingerprints are within the radius, block by block."""
    for b in range(0, len(at), LANES):
        lanes = at[b : b + LANES]
        block = Block(fps[lanes])
        for q in range(0, b + len(lanes), 256):
            asks = at[q : min(q + 256, b + len(lanes))]
            if len(np.unique(forest.tops()[np.concatenate((lanes, asks))])) > 1:
                i, j = block.within(fps[asks], radius)
                forest.join(asks[i], lanes[j])


def links_of(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(place, smallest place it reaches) among fingerprints of equal ``group`` (ascending); each but the smallest, once.

    Small groups share a block, in which each fingerprint asks for the lanes of its own group.
    """
    forest, n = Forest(len(group)), len(group)
    edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if n else 0))
    ends = np.append(edges[1:], n)
    small: list[np.ndarray] = []

    def together() -> None:
        at = np.concatenate(small)
        same = group[at][:, None] == group[at][None]
        i, j = Block(fps[at]).within(fps[at], radius, same & (at[:, None] > at[None]))
        forest.join(at[i], at[j])
        small.clear()

    for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
        if b - a > PACKED:
            _compare(fps, np.arange(a, b), forest, radius)
        elif b - a > 1:
            small.append(np.arange(a, b))
            if sum(map(len, small)) > PACKED:
                together()
    if small:
        together()
    tops = forest.tops()
    moved = np.flatnonzero(tops != np.arange(n))
    return moved, tops[moved]


def dealt(keyed: DataFrame, by: list[str], name: str, most: int, weight: Column | None = None) -> DataFrame:
    """``keyed`` with i and j: groups of equal ``by`` that weigh over ``most`` are dealt over pairs of blocks.

    The members of such a group fall into blocks of about ``most`` by a hash of ``name``, and each pair of blocks is a
    task's work, so any two members meet and none sees more than two blocks; other groups stay whole.
    """
    total = F.count("*") if weight is None else F.sum(weight)
    crowds = keyed.groupBy(*by).agg(total.alias("held")).filter(F.col("held") > most).select(*by, F.ceil(F.col("held") / most).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.col(name), F.lit("block")), F.col("blocks")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != own), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    both = keyed.join(crowds, by, "left").withColumn("ij", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)))
    return both.select(*keyed.columns, F.col("ij.i").alias("i"), F.col("ij.j").alias("j"))


def linked(keyed: DataFrame, by: list[str], words: int, radius: int) -> DataFrame:
    """(a, b) with b < a: a forest of the links within ``radius`` in each group of ``keyed`` (by, fp, and words w0, w1 ..)."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, "i", "j"]
    wide = [f"w{i}" for i in range(words)]
    # which groups follow each other does not matter, so a hash stands for the key
    rows = dealt(keyed, by, "fp", CROWD).select(F.xxhash64(*keys).alias("g"), *keys, "fp", *wide)
    together = rows.repartition(n, *keys).sortWithinPartitions("g", *keys, "fp").select("g", *keys, "fp", *wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns: number of the group, fp, words
        last, number = None, 0

        def emit(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            fp = part[:, 1]
            a, b = links_of(part[:, 2:].view(np.uint64), part[:, 0], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(fp[a], fp[b])), pa.array(np.minimum(fp[a], fp[b]))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(batch.num_columns)]
            key = np.stack(cols[: 1 + len(keys)])
            fresh = np.ones(batch.num_rows, np.int64)
            fresh[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            fresh[0] = last is None or (key[:, 0] != last).any()
            last, group = key[:, -1], number + np.cumsum(fresh)
            number = int(group[-1])
            held.append(np.stack([group, *cols[1 + len(keys) :]], axis=1))
            if sum(map(len, held)) >= LANES:
                part = np.concatenate(held)
                cut = int(np.searchsorted(part[:, 0], number))  # the last group may go on
                held[:] = [part[cut:]]
                if cut:
                    yield from emit(part[:cut])
        if held:
            yield from emit(np.concatenate(held))

    return together.mapInArrow(run, "a long, b long").distinct()


def link_table(distinct: DataFrame) -> DataFrame:
    """(a, b) with b < a for linked fingerprints of the column fp; a forest under each key."""
    keys = [F.struct(F.lit(i).alias("t"), *(F.shiftright("fp", BANDS[b][0]).bitwiseAND((1 << BANDS[b][1]) - 1).cast("int").alias(n) for b, n in zip(pair, "xy", strict=True))) for i, pair in enumerate(PAIRS)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", F.col("fp").alias("w0"), F.col("k.t").alias("t"), F.col("k.x").alias("x"), F.col("k.y").alias("y"))
    return linked(keyed, ["t", "x", "y"], 1, RADIUS)


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mark (hash of the text), fp, root (the smallest fingerprint of the component), component_id."""
    fps = materialize(fingerprints(df, key, text), "fingerprints")
    firsts = materialize(fps.groupBy("fp").agg(F.min(key).alias("first")), "firsts")
    comp = materialize(components(link_table(firsts.select("fp"))), "components")
    rooted = firsts.join(comp, firsts.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.join(ids, "root").select("fp", "root", "component_id"), "named")
    forget(firsts, comp)
    return fps.join(named, "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: the smallest key reachable over links, itself included."""
    return grouped(df, key, text).select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with the smallest key (null last), once."""
    return keep_first(df, grouped(df, key, text), key, text)


def keep_first(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` with the smallest key (null last) of each root of ``found`` (key, mark, root), once."""
    own, of_text = unused(df, "key"), unused(df, "mark")
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("mark").alias("mark"))).alias("best")
    kept = materialize(found.groupBy("root").agg(best).select(F.col("best.key").alias(own), F.col("best.mark").alias(of_text)), "kept")
    named = df.withColumn(of_text, _mark(text))
    out = named.join(kept, named[key].eqNullSafe(kept[own]) & (named[of_text] == kept[of_text]), "left_semi")
    if not found.groupBy(key, "mark").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([key, of_text])
    return out.drop(of_text)
