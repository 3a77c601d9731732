"""Byte-level BPE encoding and decoding, merging through segment trees over adjacent pair ranks.

A word is a row of symbols. The leaves of its segment tree hold ``rank * width + position`` for each mergeable
adjacent pair, so the root is the leftmost pair of lowest rank. A merge changes three leaves (the merged pair,
the pair before and the pair after), each renewed in a logarithmic number of steps; merging ends when the root
holds no pair. Words of similar length share one two-dimensional tree whose rows advance together in NumPy;
long words use the same tree one at a time.

Defined results: null text counts as empty text; empty text has no ids and decodes to empty text; equal texts
get equal ids; extra columns stay as they are, and a clashing output name is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomspan.llm.common import slices, stream

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids one worker keeps at a time.
CACHE = 200_000
#: Words up to this many bytes advance together.
BATCHED = 64
NO_PAIR = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.merged = pairs[order], order.astype(np.int64), merged
        self.rank_of = {int(p): r for r, p in reversed(list(enumerate(pairs)))}
        self.parts = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)


def merge_together(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids (as 32-bit payloads) of words that share one width, by one segment tree a row."""
    n, width = len(words), 1 << max(1, (max(map(len, words)) - 1).bit_length())
    lengths = np.fromiter(map(len, words), np.int64, n)
    raw = np.zeros((n, width), np.uint8)
    inside = np.arange(width) < lengths[:, None]
    raw[inside] = np.frombuffer(b"".join(words), np.uint8)
    symbols = v.first[raw]
    after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
    before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
    tree = np.full((n, 2 * width), NO_PAIR, np.int64)
    rows, at = np.nonzero(np.arange(width) + 1 < lengths[:, None])
    ranks = v.rank(symbols[rows, at], symbols[rows, at + 1])
    live = ranks >= 0
    tree[rows[live], width + at[live]] = ranks[live] * width + at[live]
    low = width
    while low > 1:
        low >>= 1
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
    rows = np.flatnonzero(tree[:, 1] != NO_PAIR)
    while len(rows):
        rank, at = np.divmod(tree[rows, 1], width)
        gone = after[rows, at]
        symbols[rows, at] = v.merged[rank]
        inside[rows, gone] = False
        right = after[rows, gone]
        after[rows, at] = right
        held = right < lengths[rows]
        before[rows[held], right[held]] = at[held]
        left = before[rows, at]
        first = left >= 0
        fresh = np.full(len(rows), NO_PAIR, np.int64)
        r = v.rank(symbols[rows[held], at[held]], symbols[rows[held], right[held]])
        fresh[held] = np.where(r >= 0, r * width + at[held], NO_PAIR)
        tree[rows, width + at], tree[rows, width + gone] = fresh, NO_PAIR
        r = v.rank(symbols[rows[first], left[first]], symbols[rows[first], at[first]])
        tree[rows[first], width + left[first]] = np.where(r >= 0, r * width + left[first], NO_PAIR)
        nodes = [(rows, width + at), (rows, width + gone), (rows[first], width + left[first])]
        for _ in range(width.bit_length() - 1):
            nodes = [(who, node >> 1) for who, node in nodes]
            for who, node in nodes:
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
        rows = rows[tree[rows, 1] != NO_PAIR]
    return _cut(symbols[inside], inside.sum(axis=1))


def _cut(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw, ends = flat.astype(np.uint32).tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def merge_alone(word: bytes, v: Vocabulary) -> bytes:
    """Ids of one word by one segment tree; for words too long to share a width."""
    n = len(word)
    symbols = [int(x) for x in v.first[np.frombuffer(word, np.uint8)]]
    width = 1 << max(1, (n - 1).bit_length())
    none = len(v.ranks) * width
    rank_of, size, merged = v.rank_of.get, v.size, v.merged

    def leaf(i: int, j: int) -> int:
        r = rank_of(symbols[i] * size + symbols[j])
        return none if r is None else r * width + i

    tree = [none] * (2 * width)
    tree[width : width + n - 1] = [leaf(i, i + 1) for i in range(n - 1)]
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    kept = [True] * n

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                return
            tree[node] = low

    while tree[1] < none:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        right = after[gone]
        symbols[at], kept[gone], after[at] = int(merged[rank]), False, right
        put(gone, none)
        if right < n:
            before[right] = at
            put(at, leaf(at, right))
        else:
            put(at, none)
        if before[at] >= 0:
            put(before[at], leaf(before[at], at))
    return np.array([s for s, k in zip(symbols, kept, strict=True) if k], np.uint32).tobytes()


def merge_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of each word, as 32-bit payloads."""
    out = [b""] * len(words)
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault((len(w) - 1).bit_length() if 1 < len(w) <= BATCHED else len(w) > 1 and 99, []).append(i)
    for kind, members in groups.items():
        if kind == 0:
            for i in members:
                out[i] = v.first[np.frombuffer(words[i], np.uint8)].astype(np.uint32).tobytes()
        elif kind == 99:
            for i in members:
                out[i] = merge_alone(words[i], v)
        else:
            for begin in range(0, len(members), 8192):
                part = members[begin : begin + 8192]
                for i, ids in zip(part, merge_together([words[i] for i in part], v), strict=True):
                    out[i] = ids
    return out


#: White space besides space and newline.
_RARE = re.compile(r"[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TIGHT = regex.compile(r"\s | \s")


def _spaces_alone(text: str) -> bool:
    """Whether each space stands between two characters that are no white space."""
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
        return False
    return not (_RARE.search(text) and _TIGHT.search(text))


def split_pieces(text: str, special: Iterable[str]) -> list[str]:
    """Parts of a text that can be encoded apart.

    A piece is a space and what follows up to the next one. Where each space stands between two characters that
    are no white space, no pre-token crosses the start of a piece; other texts are one piece, as are texts with
    special tokens, which the library looks for first.
    """
    if not text:
        return []
    if any(s in text for s in special) or "\0" in text or not _spaces_alone(text):
        return [text]
    return text.replace(" ", "\0 ").split("\0")


class Codec:
    """Encoder and decoder of one vocabulary; keeps the ids of recent pieces, ``CACHE`` at most."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.kept: dict[str, bytes] = {}

    def _tokens(self, piece: str) -> list[str]:
        v = self.v
        if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
            return [piece]
        if not any(s in piece for s in v.special):
            return v.parts.findall(piece)
        return [t for part in v.splitter.split(piece) if part for t in ([part] if part in v.special else v.parts.findall(part))]

    def _learn(self, pieces: Iterable[str]) -> None:
        made = [(p, self._tokens(p)) for p in pieces]
        words = list({t for _, tokens in made for t in tokens} - self.v.special.keys())
        ids_of = dict(zip(words, merge_words([w.encode() for w in words], self.v), strict=True))
        ids_of |= {t: np.array([i], np.uint32).tobytes() for t, i in self.v.special.items()}
        for piece, tokens in made:
            self.kept[piece] = ids_of[piece] if len(tokens) == 1 else b"".join([ids_of[t] for t in tokens])

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.kept) > CACHE:
            self.kept.clear()
        split = [split_pieces(t or "", self.v.special) for t in texts]
        new = set().union(*split).difference(self.kept)
        self._learn(new)
        get = self.kept.__getitem__
        out = [np.frombuffer(b"".join(map(get, pieces)), np.uint32) for pieces in split]
        for p in new:
            if len(p) > 256:
                del self.kept[p]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        known = self.v.bytes_of
        return b"".join([known[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker and vocabulary file; every node has the file at that path."""
    return Codec(path)


def _refuse(df: DataFrame, *names: str) -> None:
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns already there: {sorted(clash)}")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as ARRAY<INT>."""
    _refuse(df, ids)
    schema = StructType([*df.schema.fields, StructField(ids, ArrayType(IntegerType()))])

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, text):
                yield part | {ids: [x.astype(np.int32) for x in own.encode_batch(part[text])]}

    return stream(df, schema, rows)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``; null ids count as none."""
    _refuse(df, text)
    schema = StructType([*df.schema.fields, StructField(text, StringType())])

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        own = codec(path)
        for batch in batches:
            yield batch | {text: [own.decode(x or ()) for x in batch[ids]]}

    return stream(df, schema, rows)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256, from a round trip in one pass.

    ``with_ids`` adds the ids themselves, as ARRAY<INT>.
    """
    more = [StructField("ids", ArrayType(IntegerType()))] if with_ids else []
    schema = StructType([df.schema[key], *more, *StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        own = codec(path)
        names = [str(i) for i in range(own.v.size)]
        for batch in batches:
            for part in slices(batch, text):
                arrays = own.encode_batch(part[text])
                found = [x.tolist() for x in arrays]
                yield {
                    key: part[key],
                    "ids": [x.astype(np.int32) for x in arrays] if with_ids else None,
                    "n_tokens": [len(x) for x in found],
                    "ids_sha256": [hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest() for x in found],
                    "decoded_sha256": [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in found],
                }

    return stream(df.select(F.col(key), F.col(text)), schema, rows)
