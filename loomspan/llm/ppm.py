"""Document scores by prediction by partial matching over bytes, and by word counts as a base line.

The model is a byte-context trie of depth ``ORDER``. A symbol is looked for under the longest known context; where
it has not followed, an escape goes to the next shorter one, from which the symbols just seen are excluded; below
the empty context the symbols not seen at all share the rest evenly. With n occurrences a symbol weighs n - 1/2 and
an escape half the number of distinct symbols.

Pretrained: contexts are counted over all learning texts in tasks and summed in Spark, and the whole trie is kept,
dealt out by context. What follows a context also follows its suffixes, so all that an escape excludes is known from
the context escaped from, and a gram of six bytes has one cost. Texts are packed in blocks; each block's distinct
grams are joined with their costs, and the block's texts are scored by lookups in its own table.
Adaptive: each document is coded by a trie that starts empty and learns as it reads.

The base line sums log10((c + 0.1) / (N + 0.1 (V + 1))) over words and one end. Frequent words (a bounded table) are
looked up in tasks; the others are joined by word.

Defined results: null text counts as empty text, which is its end alone; ASCII letters are lower-cased; without any
learning text every symbol costs log10(256); rows that repeat are scored each; a null key counts as empty text in
the split; long texts are read whole; an empty table gives an empty table; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from loomspan.llm.common import fold, forget, materialize, slices, stream

ORDER = 5
#: Bytes of texts in a block, about.
BLOCK = 1 << 25
#: Bytes that UTF-8 never uses: before a text, and after it.
BEFORE, END = 0xFE, 0xFF
#: Most frequent words looked up in tasks, and bytes of the longest of them.
HEAD_WORDS, HEAD_BYTES = 65_536, 64
SLICE = 1 << 20
#: Entries of one pair of context bytes beyond which a third byte parts it.
CROWD = 10_000
_TOP, _SPREAD = np.uint64(ORDER << 56), np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """A byte-context trie of a fixed depth, for one document at a time."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.next: dict[bytes, dict[int, int]] = {}

    def learn(self, context: bytes, symbol: int) -> None:
        for j in range(self.order + 1):
            after = self.next.setdefault(context[len(context) - j :], {})
            after[symbol] = after.get(symbol, 0) + 1

    def cost(self, context: bytes, symbol: int) -> float:
        """log10 of the symbol's probability after the context."""
        total, excluded = 0.0, set()
        for j in range(self.order, -1, -1):
            after = self.next.get(context[len(context) - j :])
            if not after:
                continue
            weights = {s: n - 0.5 for s, n in after.items() if s not in excluded}
            escape = len(after) / 2
            room = sum(weights.values()) + escape
            if symbol in weights:
                return total + math.log10(weights[symbol] / room)
            total += math.log10(escape / room)
            excluded |= after.keys()
        return total - math.log10(256 - len(excluded))

    def read(self, text: str | None, score: bool = True, learn: bool = True) -> float:
        """log10 probability of a text and its end."""
        data = bytes([BEFORE]) * self.order + (text or "").encode().lower() + bytes([END])
        total = 0.0
        for i in range(self.order, len(data)):
            context = data[i - self.order : i]
            if score:
                total += self.cost(context, data[i])
            if learn:
                self.learn(context, data[i])
        return total


def grams(lines: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(order + 1 bytes ending at each symbol as a number, symbols of each lower-cased text)."""
    pad = bytes([BEFORE]) * order
    sizes = np.array([len(x) + 1 for x in lines], np.int64)
    raw = np.frombuffer(b"".join(pad + x + bytes([END]) for x in lines), np.uint8)
    keys = np.zeros(len(raw) - order, np.uint64)
    for j in range(order + 1):
        keys = (keys << np.uint64(8)) | raw[j : j + len(keys)]
    symbol = np.ones(len(keys), bool)
    firsts = np.cumsum(sizes + order) - sizes - order  # of each text's first symbol, as a key
    for i in range(1, order + 1):
        symbol[firsts[1:] - i] = False
    return keys[symbol], sizes


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    edges = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[edges], np.add.reduceat(n, edges)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edges = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[edges], np.diff(np.append(edges, len(keys)))


def tagged(keys: np.ndarray, n: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all orders (the order in the top byte) from those of the highest."""
    all_keys, all_n = [], []
    for j in range(order, -1, -1):
        all_keys.append(keys | np.uint64(j << 56))
        all_n.append(n)
        if j:
            keys, n = _summed(keys & np.uint64((1 << 8 * j) - 1), n)
    return np.concatenate(all_keys), np.concatenate(all_n)


def blocks(docs: DataFrame, held_out: str, key: str = "doc_id", text: str = "text", most: int = BLOCK) -> DataFrame:
    """Rows of texts with keys, packed: (block, keys, held_out, sizes, length, packed, words), and at the last one of
    each block its distinct grams and how often learning texts have each (0: only others do).

    A block is at most ``most`` bytes, or one text, of one partition.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter[bytes] = Counter()
        block, filled, docs_in = TaskContext.get().partitionId() << 16, 0, 0

        def merge() -> None:
            if len(held) > 1:
                held[:] = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]

        def row(keys: list, outs: list, lines: list[bytes], close: bool) -> dict:
            k, n = [None], [None]
            if close:
                merge()
                found = held.pop()
                k, n = [found[0].astype("<u8").tobytes()], [found[1].astype("<i8").tobytes()]
            raw = b"".join(lines)
            listed = []
            if close or len(words) > 400_000:
                listed = [{"word": w, "n": c} for w, c in words.items()]
                words.clear()
            return {"block": [block], "keys": [keys], "held_out": [outs], "sizes": [[len(x) for x in lines]], "length": [len(raw)], "packed": [pa.compress(raw, codec="zstd", asbytes=True)], "words": [listed], "grams": k, "n": n}

        waiting = None
        for batch in batches:
            for part in slices(batch, text, SLICE):
                if waiting:
                    close = filled >= most or docs_in >= 1 << 20
                    yield row(*waiting, close)
                    if close:
                        block, filled, docs_in = block + 1, 0, 0
                lines = [(t or "").encode().lower() for t in part[text]]
                for out in (False, True):
                    some = [x for x, o in zip(lines, part[held_out], strict=True) if o == out]
                    if some:
                        k, n = _counted(grams(some)[0])
                        held.append((k, n * (not out)))
                        if not out:
                            for x in some:
                                words.update(x.split())
                            words[b""] += len(some)
                if len(held) >= 8:
                    merge()
                filled, docs_in = filled + sum(map(len, lines)), docs_in + len(lines)
                waiting = part[key], part[held_out], lines
        if waiting:
            yield row(*waiting, True)

    kind = StructType([*StructType.fromDDL("block long").fields, StructField("keys", ArrayType(docs.schema[key].dataType)), *StructType.fromDDL("held_out array<boolean>, sizes array<long>, length long, packed binary, words array<struct<word: binary, n: long>>, grams binary, n binary").fields])
    return stream(docs.select(key, text, held_out), kind, rows)


def lines_of(packed: bytes, length: int, sizes: list[int]) -> list[bytes]:
    raw = pa.decompress(packed, decompressed_size=length, codec="zstd", asbytes=True)
    ends = np.cumsum([0, *sizes]).tolist()
    return [raw[a:b] for a, b in pairwise(ends)]


def count(packed: DataFrame) -> DataFrame:
    """(entry, n): the trie's entries of all orders, and those of the longest order that only other texts have (n = 0)."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for k, n in zip(batch["grams"], batch["n"], strict=True):
                keys, times = np.frombuffer(k, "<u8"), np.frombuffer(n, "<i8")
                known = times > 0
                made = [tagged(keys[known], times[known])] if known.any() else []
                made.append((keys[~known] | _TOP, times[~known]))
                for entry, times in made:
                    for i in range(0, len(entry), 200_000):
                        yield {"entry": entry[i : i + 200_000].view(np.int64), "n": times[i : i + 200_000]}

    return stream(packed.filter("grams is not null").select("grams", "n"), "entry long, n long", rows).groupBy("entry").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` rows of ``counts`` have it or more."""
    bucket = F.floor(F.log2("n") * 4).cast("int")
    left, least = most, 1
    for r in sorted(counts.groupBy(bucket.alias("b")).count().collect(), key=lambda r: -r.b):
        left -= r["count"]
        if left < 0:
            return math.floor(2 ** ((r.b + 1) / 4)) + 1
    return least


class Model:
    """The pretrained trie as sorted arrays. Entries are (order, context, symbol), nodes (order, context)."""

    def __init__(self, entries: np.ndarray, n: np.ndarray, order: int = ORDER):
        self.order = order
        sort = np.argsort(entries)
        self.entries, n = entries[sort], n[sort].astype(np.float64)
        levels = (self.entries >> np.uint64(56)).astype(np.int64)
        contexts = (self.entries & np.uint64((1 << 56) - 1)) >> np.uint64(8)
        nodes = contexts | (levels.astype(np.uint64) << np.uint64(56))
        edges = np.flatnonzero(np.diff(nodes, prepend=~nodes[:1])) if len(nodes) else np.empty(0, np.int64)
        self.nodes = nodes[edges]
        self.weights = n - 0.5
        held = np.add.reduceat(n, edges) if len(edges) else np.empty(0)
        distinct = np.diff(np.append(edges, len(nodes)))
        node_levels = (self.nodes >> np.uint64(56)).astype(np.int64)
        node_contexts = self.nodes & np.uint64((1 << 56) - 1)
        self.escapes = distinct / 2
        self.rooms = held
        # what is left at the suffix when this node's symbols are excluded
        whose = np.repeat(np.arange(len(self.nodes)), distinct)
        lower = np.maximum(levels - 1, 0).astype(np.uint64)
        cut = (self.entries & ((np.uint64(1) << (np.uint64(8) * (lower + np.uint64(1)))) - np.uint64(1))) | (lower << np.uint64(56))
        at, known = self._find(self.entries, cut)
        gone = np.bincount(whose, np.where(known, self.weights[at], 0), minlength=len(self.nodes)) if len(n) else np.empty(0)
        below = np.maximum(node_levels - 1, 0).astype(np.uint64)
        suffix = (node_contexts & ((np.uint64(1) << (np.uint64(8) * below)) - np.uint64(1))) | (below << np.uint64(56))
        at, _ = self._find(self.nodes, suffix)
        self.left = self.rooms[at] - gone if len(n) else np.empty(0)
        self.rest = math.log10(256 - int((levels == 0).sum()))

    @staticmethod
    def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(among):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return at, among[at] == keys

    def costs(self, grams_: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        out = np.zeros(len(grams_))
        room = np.zeros(len(grams_))  # of the current level, 0 above the deepest known context
        open_ = np.arange(len(grams_))
        for j in range(self.order, -1, -1):
            tag = np.uint64(j << 56)
            gram = grams_[open_] & np.uint64((1 << 8 * (j + 1)) - 1)
            node, known = self._find(self.nodes, (gram >> np.uint64(8)) | tag)
            fresh = known & (room[open_] == 0)
            room[open_[fresh]] = self.rooms[node[fresh]]
            at, held = self._find(self.entries, gram | tag)
            held &= known
            out[open_[held]] += np.log10(self.weights[at[held]] / room[open_[held]])
            gone = known & ~held
            out[open_[gone]] += np.log10(self.escapes[node[gone]] / room[open_[gone]])
            room[open_[gone]] = self.left[node[gone]]
            open_ = open_[~held]
        out[open_] -= self.rest
        return out


def costs(counts: DataFrame, most: int = 200_000, crowd: int = CROWD) -> DataFrame:
    """(gram, cost) of each gram in ``counts``.

    The trie is dealt out by the last two bytes of the context, and by three where two have over ``crowd`` entries (the
    entries of order 2 then go to each third byte that occurs). The orders 0 and 1 have 65,792 entries at most and are sent to all
    tasks; a task holds those and some ``most`` other entries, or those of one deal.
    """
    spark = counts.sparkSession
    order = F.shiftrightunsigned("entry", 56)
    low = counts.filter((order <= 1) & (F.col("n") > 0)).toArrow()
    base = spark.sparkContext.broadcast((low["entry"].to_numpy().view(np.uint64), low["n"].to_numpy()))
    pair = F.shiftrightunsigned("entry", 8).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("pair")
    rest = counts.filter(order >= 2).select("entry", "n", pair)
    crowds = [r.pair for r in rest.groupBy("pair").count().filter(F.col("count") > crowd).collect()]  # 65,536 pairs at most

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        low_entries, low_n = base.value

        def priced(found: np.ndarray) -> Iterator[dict]:
            # entries of order 2 come once a deal
            entries, first = np.unique(found[0].view(np.uint64), return_index=True)
            n = found[1][first]
            known = n > 0
            model = Model(np.concatenate([low_entries, entries[known]]), np.concatenate([low_n, n[known]]))
            own = entries[entries >> np.uint64(56) == ORDER] & ~_TOP
            if len(own):
                yield {"gram": own.view(np.int64), "cost": model.costs(own).astype(np.float32)}

        for batch in batches:
            held.append(np.array([batch["entry"], batch["n"], batch["deal"]], np.int64))
            if sum(x.shape[1] for x in held) < most:
                continue
            found = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(found[2], found[2, -1]))  # the last deal may go on
            held[:] = [found[:, cut:]]
            if cut:
                yield from priced(found[:, :cut])
        if held:
            yield from priced(np.concatenate(held, axis=1))

    deal = F.col("pair").cast("long") * 257
    dealt = rest.select("entry", "n", deal.alias("deal"))
    if crowds:
        parted = rest.filter(F.col("pair").isin(crowds))
        third = (F.shiftrightunsigned("entry", 24).bitwiseAND(F.lit(0xFF)) + 1).alias("third")
        deep = parted.filter(order > 2).select("entry", "n", "pair", third)
        shallow = parted.filter(order == 2).join(deep.select("pair", "third").distinct(), "pair").select("entry", "n", "pair", "third")
        whole = rest.filter(~F.col("pair").isin(crowds)).select("entry", "n", deal.alias("deal"))
        dealt = whole.union(deep.union(shallow).select("entry", "n", (deal + F.col("third")).alias("deal")))
    return stream(dealt.repartition("deal").sortWithinPartitions("deal"), "gram long, cost float", rows)


def wanted(packed: DataFrame) -> DataFrame:
    """(block, gram): the distinct grams of each block."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for block, k in zip(batch["block"], batch["grams"], strict=True):
                keys = np.frombuffer(k, "<i8")
                for i in range(0, len(keys), 200_000):
                    part = keys[i : i + 200_000]
                    yield {"block": np.full(len(part), block), "gram": part}

    return stream(packed.filter("grams is not null").select("block", "grams"), "block long, gram long", rows)


class Prices:
    """Open addressing table of the costs of grams; every gram that is asked for must be in it."""

    def __init__(self, grams_: np.ndarray, costs_: np.ndarray):
        power = max(10, (3 * len(grams_)).bit_length())
        self.shift, mask = 64 - power, (1 << power) - 1
        self.keys, self.costs = np.zeros(1 << power, np.uint64), np.zeros(1 << power, np.float32)
        open_ = grams_ | _TOP  # never zero
        slot = (open_ * _SPREAD >> np.uint64(self.shift)).astype(np.int64)
        while len(open_):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = open_[free]
            won = self.keys[slot] == open_
            self.costs[slot[won]] = costs_[won]
            open_, costs_, slot = open_[~won], costs_[~won], (slot[~won] + 1) & mask

    def __call__(self, lines: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        keys, sizes = grams(lines)
        keys |= _TOP
        slot = (keys * _SPREAD >> np.uint64(self.shift)).astype(np.int64)
        open_ = np.flatnonzero(self.keys[slot] != keys)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
        return np.add.reduceat(self.costs[slot].astype(np.float64), np.cumsum(sizes) - sizes)


@lru_cache(maxsize=4096)
def _log(c: int) -> float:
    return math.log10(c + 0.1)


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows not held out."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out.alias("held_out"))
    packed = materialize(blocks(own, "held_out", "key", "text", block), "blocks")
    words = materialize(packed.select(F.explode("words").alias("w")).groupBy("w.word").agg(F.sum("w.n").alias("c")), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    room = math.log10(tokens + 0.1 * (distinct + 1))
    short = words.filter(F.octet_length("word") <= HEAD_BYTES)
    least = _least_count(short.withColumnRenamed("c", "n"), HEAD_WORDS)
    head = short.filter(F.col("c") >= least).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(head["word"].to_pylist(), head["c"].to_pylist(), strict=True)))
    counts = materialize(count(packed), "counts")
    priced = wanted(packed).join(costs(counts), "gram").select("block", "gram", "cost")

    tail_kind = "n_tokens long, head_known long, head_sum double, score double, tail array<struct<word: binary, tf: long>>"
    kind = StructType([*StructType.fromDDL("row long").fields, StructField("key", docs.schema[key].dataType), *StructType.fromDDL("held_out boolean").fields, *StructType.fromDDL(tail_kind).fields])
    arrow = to_arrow_schema(kind)

    def rows(texts: pa.Table, prices: pa.Table) -> pa.Table:
        find, made, row = known.value.get, [], None
        price = Prices(prices["gram"].to_numpy().view(np.uint64), prices["cost"].to_numpy())
        for i in range(texts.num_rows):
            part = texts.slice(i, 1).to_pylist()[0]
            row = part["block"] << 24 if row is None else row
            lines = lines_of(part["packed"], part["length"], part["sizes"])
            n_tokens, n_known, sums, tails = [], [], [], []
            for x in lines:
                found = x.split()
                found.append(b"")
                total, seen, tail = 0.0, 0, []
                for w, tf in Counter(found).items():
                    c = find(w)
                    if c is None:
                        tail.append({"word": w, "tf": tf})
                    else:
                        total += tf * _log(c)
                        seen += tf
                n_tokens.append(len(found))
                n_known.append(seen)
                sums.append(total)
                tails.append(tail)
            out = [range(row, row + len(lines)), part["keys"], part["held_out"], n_tokens, n_known, sums, price(lines), tails]
            made.append(pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out, arrow.types, strict=True)], schema=arrow))
            row += len(lines)
        return pa.Table.from_batches(made, arrow)

    texts = packed.select("block", "keys", "held_out", "sizes", "length", "packed")
    scored = materialize(texts.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(rows, kind), "scored")
    forget(packed)
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    joined = tail.join(words, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = joined.groupBy("row").agg(F.sum(F.col("tf") * F.log10(c + 0.1)).alias("tail_sum"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    zero = F.lit(0)
    return scored.drop("tail").join(sums, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", zero.cast("double")) - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        "score",
    )


def score_adaptive(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key and score: each document by a trie of its own that learns as it reads."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {key: batch[key], "score": [Trie(order).read(t) for t in batch[text]]}

    return stream(docs.select(key, text), StructType([docs.schema[key], *StructType.fromDDL("score double").fields]), rows)


def is_held_out(key: str = "doc_id", parts: int = 10, which: int = 0) -> Column:
    return fold(key, parts) == which

