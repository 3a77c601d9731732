"""SimHash near-duplicates at a Jaccard similarity, for near-duplicate stages on word shingles.

Texts are linked where their sets of five-word shingles have a similarity of 0.8 or more. A fingerprint of 64 bits
and a radius of 3 as in ``simhash`` finds a tenth of such pairs, so fingerprints have 256 bits here and the radius is
72: two sets at exactly 0.8 differ in 39 bits on average (48 for the smallest sets) with a deviation of 6, sets with
nothing in common in 128. Equal sets are first folded into one row.

1. A fingerprint goes under ``BANDS`` keys of ``ROWS`` minimum hashes each (a pair at exactly 0.8 shares none with a
   probability of 3 in 100,000). Under a key, bit planes and carry-save counters find those within the radius, as in
   ``simhash``; what comes out is a forest, and its components are the groups of possible copies.
2. The whole sets of each group of two or more come together once, and every pair that is not joined already is
   compared exactly; what comes out is again a forest, whose components are the classes.

Keys and groups that are too large for one task are dealt over pairs of blocks (``simhash.dealt``), so no pair is lost
and no task holds more than two blocks.

Defined results: null and empty text have no shingle and are copies of each other; fewer words than a shingle make
one shingle of all; repeats of a shingle count once; words and case are those of SimHash; rows that share a key are
rows of their own; an empty table gives an empty table; other columns, of whatever name, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.llm import simhash
from loomspan.llm.common import forget, materialize, slices, stream
from loomspan.operators.components import components

#: Words of a shingle; linked pairs share at least ALIKE[0] / ALIKE[1] of their union.
SHINGLE, ALIKE = 5, (4, 5)
#: 64-bit words of a fingerprint, and differing bits at most.
WORDS, RADIUS = 4, 72
BANDS, ROWS, SEED = 20, 4, 42
#: Shingles of a group of possible copies in one block.
BLOCK = 400_000
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of minimum hashes; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048] * _RANDOM[0] + _RANDOM[1]).min(axis=1))
    key = np.zeros(BANDS, np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> list[int]:
    """``WORDS`` words of bits that are set in over half of the hashes, each word by a hash of its own."""
    out = []
    for i in range(WORDS):
        x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * i & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(simhash.fingerprint(x ^ (x >> np.uint64(31))))
    return np.array(out, np.uint64).view(np.int64).tolist()


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark (hash of the text), fp (hash of the set of shingles, 0 for none), n (its size), bands, w (fingerprint)."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, text):
                sets = [shingle_set(t) for t in part[text]]
                fp = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) if len(s) else 0 for s in sets]
                yield {key: part[key], "mark": part["mark"], "fp": fp, "n": [len(s) for s in sets], "bands": [band_keys(s) for s in sets], "w": [fingerprint(s) for s in sets]}

    kind = StructType([df.schema[key], *StructType.fromDDL("mark long, fp long, n long, bands array<long>, w array<long>").fields])
    return stream(df.select(key, text, simhash._mark(text).alias("mark")), kind, rows)


def _sets(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``wanted`` (fp, root, at: none, key and mark of one text that has it) with the shingles h."""
    at = wanted.select("fp", "root", F.col("at.k").alias("k"), F.col("at.mark").alias("m"))
    own = df.select(F.col(key).alias("own"), F.col(text).alias("t"), simhash._mark(text).alias("own_mark"))
    found = own.join(at, own["own"].eqNullSafe(at["k"]) & (own["own_mark"] == at["m"])).select("fp", "root", "t")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield {"fp": part["fp"], "root": part["root"], "h": [shingle_set(t).view(np.int64) for t in part["t"]]}

    # rows that share key and text are one
    return stream(found, "fp long, root long, h array<long>", rows).dropDuplicates(["fp"])


def alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, smallest place it reaches) of sets that are alike; each but the smallest, once."""
    forest, sizes = simhash.Forest(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets))
    whose = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    held = whose[order]  # sets that hold each shingle, one shingle after another
    ends = np.cumsum(np.bincount(code))
    starts = ends - np.diff(ends, prepend=0)
    own = np.split(code, np.cumsum(sizes)[:-1])
    for q in range(1, len(sets)):
        tops = forest.tops()
        if (tops[:q] == tops[q]).all():
            continue
        shared = np.bincount(np.concatenate([held[starts[c] : ends[c]] for c in own[q].tolist()]), minlength=len(sets))[:q]
        close = np.flatnonzero((tops[:q] != tops[q]) & (shared * sum(ALIKE) >= (sizes[:q] + sizes[q]) * ALIKE[0]))
        if len(close):
            forest.join(np.full(len(close), q), close)
    tops = forest.tops()
    moved = np.flatnonzero(tops != np.arange(len(sets)))
    return moved, tops[moved]


def _confirmed(sets: DataFrame) -> DataFrame:
    """(a, b) with b < a: a forest of the sets (fp, root, h) of one root that are alike."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["root", "i", "j"]
    together = simhash.dealt(sets, ["root"], "fp", BLOCK, F.size("h")).repartition(n, *keys).sortWithinPartitions(*keys, "fp")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        last, fps, held = None, [], []

        def close() -> Iterator[dict]:
            if len(fps) > 1:
                a, b = alike(held)
                if len(a):
                    at = np.array(fps)
                    yield {"a": at[a], "b": at[b]}

        for batch in batches:
            for *k, fp, h in zip(*(batch[c] for c in keys), batch["fp"], batch["h"], strict=True):
                if k != last:
                    yield from close()
                    last, fps, held = k, [], []
                fps.append(fp)
                held.append(np.array(h, np.int64).view(np.uint64))
        yield from close()

    return stream(together.select(*keys, "fp", "h"), "a long, b long", rows).distinct()


def _rooted(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    return nodes.join(comp, nodes["fp"] == comp["node"], "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mark (hash of the text), fp, root (the smallest fp of the class)."""
    marked = materialize(_marked(df, key, text), "marked")
    one = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "mark")).alias("at")
    nodes = materialize(marked.groupBy("fp").agg(one, F.first("bands").alias("bands"), F.first("w").alias("w")), "nodes")
    words = [F.col("w")[i].alias(f"w{i}") for i in range(WORDS)]
    keyed = nodes.select("fp", *words, F.posexplode("bands").alias("t", "band"))
    loose = materialize(simhash.linked(keyed, ["t", "band"], WORDS, RADIUS), "loose")
    groups = components(loose)
    wanted = nodes.select("fp", "at").join(groups.withColumnRenamed("node", "fp"), "fp")
    sets = materialize(_sets(df, wanted, key, text), "sets")
    links = materialize(_confirmed(sets), "links")
    comp = components(links)
    forget(nodes, loose, sets, links)
    return _rooted(marked.select(key, "mark", "fp"), comp)


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each class the one with the smallest key (null last), once."""
    return simhash.keep_first(df, grouped(df, key, text), key, text)
