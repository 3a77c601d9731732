"""Token ids in binary shards, found through minimal perfect hash indexes.

A shard file is: the raw ids of its documents one after another, the index, and a trailer (a JSON header with the
length of each part, and the header's own length in 8 bytes). The index holds the distinct keys, the first id of each
row, and a minimal perfect hash from keys to places; a place holds a 32-bit fingerprint, the key's first row and its
number of rows. A lookup hashes the key, walks a few bit levels, counts bits below (constant time by stored block
counts), tests the fingerprint and reads the offsets. Levels are as in collision bit arrays: keys alone in their bit
stay, others go on to the next level. Rows are read back by such lookups only.

Files are written by tasks under names of their own attempt and become part of a store only through the manifest
table that Spark commits, so a task that is lost and run again leaves no half shard behind.

Defined results: null text counts as empty text and has the end id alone; rows come in ascending key order, null
keys first, rows of one key in the order of a hash of their text; a key held by many rows finds all of them, dealt over
shards where they are many; keys of any type that can be ordered are kept; an empty table gives an empty manifest;
extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomspan.llm.bpe import split_pieces
from loomspan.llm.common import materialize, scratch_path, slices, stream

#: Bytes of payload after which a shard ends at the next new key.
SHARD_BYTES = 64 << 20
#: Pieces whose ids one worker keeps at a time.
CACHE = 1_600_000
#: Bits a key at each level, and levels before the rest is stored as it is.
GAMMA, LEVELS = 2.0, 24


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(keys: list, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(repr(k).encode(), seed) for k in keys), np.uint64, len(keys))


class PerfectHash:
    """Maps n distinct keys to 0..n-1, each in constant time; keys themselves are not stored."""

    def __init__(self, seed: int, levels: list[np.ndarray], rest: np.ndarray):
        self.seed, self.levels, self.rest = seed, levels, rest
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        ends = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.below = [np.cumsum(c) - c + e for c, e in zip(counts, ends, strict=False)]
        self.held = int(ends[-1])

    @classmethod
    def build(cls, keys: list) -> PerfectHash:
        seed = 0
        while len(np.unique(left := _hashes(keys, seed))) < len(keys):
            seed += 1
        levels = []
        while len(left) and len(levels) < LEVELS:
            size = max(64, int(GAMMA * len(left) + 63) // 64 * 64)
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(seed, levels, np.sort(left))

    def __call__(self, keys: list) -> np.ndarray:
        """Place of each key; a key that is not of the set gets any place, or -1."""
        h = _hashes(keys, self.seed)
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, words in enumerate(self.levels):
            at = (_mix(h[open_], level) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[here]] = (self.below[level][at >> 6] + under)[here]
            open_ = open_[~here]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, h[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == h[open_], self.held + at, -1)
        return out


class ShardWriter:
    """One shard file being written; ``close`` gives its manifest row."""

    def __init__(self, root: str, width: int, key_type: pa.DataType):
        self.uri = f"{root}/{uuid.uuid4().hex}.ids"
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.width, self.key_type = fs.open_output_stream(path), width, key_type
        self.keys: list = []
        self.firsts: list[int] = []
        self.n = 0

    def add(self, key, payload: bytes) -> None:
        self.keys.append(key)
        self.firsts.append(self.n)
        self.out.write(payload)
        self.n += len(payload) // self.width

    def close(self) -> dict:
        rows = Counter(self.keys)  # rows of one key follow each other
        distinct, times = list(rows), np.array(list(rows.values()), np.int64)
        mph = PerfectHash.build(distinct)
        place = mph(distinct)
        row_at, row_n, mark = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64), np.empty(len(distinct), np.uint32)
        row_at[place], row_n[place] = np.cumsum(times) - times, times
        mark[place] = _hashes(distinct, mph.seed + 1000).astype(np.uint32)
        names = pa.BufferOutputStream()
        with pa.ipc.new_stream(names, pa.schema([("key", self.key_type)])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(distinct, self.key_type)], names=["key"]))
        firsts = np.array([*self.firsts, self.n], np.int64)
        blocks = [names.getvalue().to_pybytes(), *(x.tobytes() for x in (firsts, row_at, row_n, mark, mph.rest, *mph.levels))]
        for block in blocks:
            self.out.write(block)
        head = json.dumps({"width": self.width, "ids": self.n, "seed": mph.seed, "blocks": [len(b) for b in blocks]}).encode()
        self.out.write(head)
        self.out.write(len(head).to_bytes(8, "little"))
        self.out.close()
        return {"file": self.uri, "n_docs": len(self.keys), "n_ids": self.n}


class Shard:
    """A shard file open for keyed access."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.uri, self.file = uri, fs.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        head = json.loads(self.file.read_at(n, size - 8 - n))
        self.width, self.n = head["width"], head["ids"]
        at, parts = self.width * self.n, []
        for length in head["blocks"]:
            parts.append(self.file.read_at(length, at))
            at += length
        self.keys = pa.ipc.open_stream(parts[0]).read_all()["key"].to_pylist()
        self.firsts, self.row_at, self.row_n = (np.frombuffer(x, np.int64) for x in parts[1:4])
        self.marks = np.frombuffer(parts[4], np.uint32)
        self.mph = PerfectHash(head["seed"], [np.frombuffer(x, np.uint64) for x in parts[6:]], np.frombuffer(parts[5], np.uint64))

    def find(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """(first row, rows) of each key; no row where the fingerprint at its place is not its own."""
        place = self.mph(keys)
        known = place >= 0
        marks = _hashes(keys, self.mph.seed + 1000).astype(np.uint32)
        known[known] = self.marks[place[known]] == marks[known]
        at = np.where(known, place, 0)
        return self.row_at[at], np.where(known, self.row_n[at], 0)

    def ids(self, row: int, rows: int = 1) -> np.ndarray:
        """Ids of ``rows`` rows from one on, by one read."""
        a, b = int(self.firsts[row]), int(self.firsts[row + rows])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def get(self, key) -> list[np.ndarray]:
        """Ids of every row of ``key``."""
        (first,), (rows,) = self.find([key])
        return [self.ids(i) for i in range(int(first), int(first + rows))]


class LibraryEncoder:
    """The tokenizers library, asked once for each piece that is not kept.

    Pieces go to the library many at a time, parted by a character that the vocabulary merges with nothing. That
    holds for pieces that start with a space, do not end with white space and do not hold that character (text with
    NUL is not split); the others go one by one. A full
    stop or comma after a letter is a token of its own, so such a piece is its word and that token.
    """

    PART = "\0"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.own.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.kept: dict[str, bytes] = {}
        part = self.own.encode(self.PART, add_special_tokens=False)
        letter = part.tokens[0] if len(part.ids) == 1 else ""
        self.part_id = part.ids[0] if letter and not any(letter in t and t != letter for t in self.own.get_vocab()) else None

    def _ask(self, pieces: list[str]) -> None:
        found = self.own.encode_batch_fast(pieces, add_special_tokens=False)
        for piece, e in zip(pieces, found, strict=True):
            self.kept[piece] = np.array(e.ids, self.kind).tobytes()

    def _ask_joined(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 256):
            group = pieces[at : at + 256]
            ids = np.array(self.own.encode_batch_fast([self.PART.join(group)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.part_id)
            raw, w = ids.tobytes(), self.width
            starts = [0, *(w * (ends + 1)).tolist()]
            stops = [*(w * ends).tolist(), len(raw)]
            for piece, i, j in zip(group, starts, stops, strict=True):
                self.kept[piece] = raw[i:j]

    def __call__(self, texts: list[str | None], end: int | None) -> Iterator[bytes]:
        """Payload of each text, with the end id."""
        if len(self.kept) > CACHE:
            self.kept.clear()
        kept = self.kept
        tail = b"" if end is None else np.array([end], self.kind).tobytes()
        split = [split_pieces(t or "", self.special) for t in texts]
        new = set().union(*split).difference(kept)
        stopped = [p for p in new if len(p) > 2 and p[-1] in ".," and p[-2].isalpha()]
        asked = (new.difference(stopped) | {p[:-1] for p in stopped} | {".", ","}).difference(kept)
        if self.part_id is None:
            self._ask(list(asked))
        else:
            joined = [p for p in asked if p[0] == " " and not p[-1].isspace() and self.PART not in p]
            self._ask(list(asked.difference(joined)))
            self._ask_joined(joined)
        for p in stopped:
            kept[p] = kept[p[:-1]] + kept[p[-1]]
        get = kept.__getitem__
        for pieces in split:
            yield b"".join(map(get, pieces)) + tail
        for p in [p for p in new if len(p) > 256]:
            kept.pop(p, None)
            kept.pop(p[:-1], None)


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(df: DataFrame, tokenizer: str, end: int | None = 2, key: str = "doc_id", text: str = "text", root: str | None = None) -> DataFrame:
    """Write ``text`` as ids in ascending ``key`` order; the manifest: part, seq, file, n_docs, n_ids, start."""
    spark = df.sparkSession
    root = root or scratch_path(spark, "idstore")
    key_type = to_arrow_type(df.schema[key].dataType)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        own, shard, seq, part_id = library(tokenizer), None, 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, text):
                for k, payload in zip(part[key], own(part[text], end), strict=True):
                    if shard and shard.n * own.width >= SHARD_BYTES:
                        yield {n: [v] for n, v in (shard.close() | {"part": part_id, "seq": seq}).items()}
                        shard, seq = None, seq + 1
                    shard = shard or ShardWriter(root, own.width, key_type)
                    shard.add(k, payload)
        if shard:
            yield {n: [v] for n, v in (shard.close() | {"part": part_id, "seq": seq}).items()}

    # the hash deals the rows of a hot key over partitions
    named = df.select(key, text).withColumn("hash of the text", F.xxhash64(text))
    order = [F.col(key), F.col("hash of the text")]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order, text).drop("hash of the text")
    done = materialize(stream(ordered, "part int, seq int, file string, n_docs long, n_ids long", rows), "manifest")
    # a row a partition goes through one task, the shards of a partition through its own
    whole = done.groupBy("part").agg(F.sum("n_ids").alias("held"))
    base = whole.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return done.join(base, "part").withColumn("start", F.col("base") + within).drop("base")


def read(manifest: DataFrame, key_type: str = "long", key: str = "doc_id", most: int = 1 << 20) -> DataFrame:
    """Rows read back through the index of each shard: key, start, n_tokens, ids_crc32 and the shard's file.

    Every key of a shard is looked up: its hash gives its place, the fingerprint there is tested, and the place gives
    the rows and their offsets. Runs of rows (about ``most`` ids) come by one read each.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for file, start in zip(b["file"], b["start"], strict=True):
                shard = Shard(file)
                first, held = shard.find(shard.keys)
                if not held.all():
                    raise ValueError(f"{file}: a key is not found through its index")
                whose = np.repeat(np.arange(len(shard.keys)), held)
                row = np.arange(len(whose)) - np.repeat(np.cumsum(held) - held, held) + first[whose]
                lo, hi = shard.firsts[row], shard.firsts[row + 1]
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(hi - lo) // most)) + 1).tolist(), len(row)]
                for i, j in pairwise(cuts):
                    if i == j:
                        continue
                    a, z = int(row[i:j].min()), int(row[i:j].max()) + 1
                    wide, base = shard.ids(a, z - a).astype("<u4"), int(shard.firsts[a])
                    yield {
                        key: [shard.keys[k] for k in whose[i:j]],
                        "start": start + lo[i:j],
                        "n_tokens": hi[i:j] - lo[i:j],
                        "ids_crc32": [zlib.crc32(wide[x:y]) for x, y in zip((lo[i:j] - base).tolist(), (hi[i:j] - base).tolist(), strict=True)],
                        "file": [file] * (j - i),
                    }

    files = manifest.select("file", "start")
    spread = files.repartition(max(1, files.count()), "file")
    return stream(spread, f"{key} {key_type}, start long, n_tokens long, ids_crc32 long, file string", rows)
