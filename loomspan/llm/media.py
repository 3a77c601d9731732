"""Binary media columns: bytes stored losslessly as PNG, read back with checksum tests, and hashed by low frequencies.

The container is read and written here: signature, chunks with CRC-32, one zlib stream of filtered scan lines.
The writer takes for each line the filter of least absolute sum among those asked for; the reader undoes all five.
Pictures are 8-bit grey. The hash shrinks the picture to 32 x 32 block means, takes the low-frequency 8 x 8 corner
of its cosine transform, and sets a bit for each coefficient above their median (the constant one left out).

Defined results: null text counts as empty, a null key stays null; repeated rows each have their picture; an empty
table gives an empty table; other columns stay in ``to_media``, which refuses a name that is taken, and are ignored in
``report``; a payload is padded with bytes 0 to a positive multiple of the width, so
empty text is one line of zeros; equal payloads give equal files and features; a damaged file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from loomspan.llm.common import materialize, slices, stream

#: Fixed values of the container.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
#: Samples a line of a stored payload, and lines of one picture part that are filtered at a time.
WIDTH, LINES = 64, 1 << 16
LEVEL = 6


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def filter_lines(pixels: np.ndarray, above: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
    """Filtered lines, each with its filter byte; ``above`` is the line before the first."""
    n, width = pixels.shape
    up = np.concatenate([above[None], pixels[:-1]])
    left = np.zeros_like(pixels)
    left[:, 1:] = pixels[:, :-1]
    made = []
    for kind in kinds:
        if kind == NONE:
            guess = np.zeros_like(pixels)
        elif kind == SUB:
            guess = left
        elif kind == UP:
            guess = up
        elif kind == AVERAGE:
            guess = ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
        else:
            corner = np.zeros_like(pixels)
            corner[:, 1:] = up[:, :-1]
            guess = _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)
        made.append(pixels - guess)
    out = np.empty((n, width + 1), np.uint8)
    if len(kinds) == 1:
        out[:, 0], out[:, 1:] = kinds[0], made[0]
        return out
    cost = np.stack([abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in made])
    best = cost.argmin(axis=0)
    out[:, 0] = np.array(kinds, np.uint8)[best]
    for i, x in enumerate(made):
        out[best == i, 1:] = x[best == i]
    return out


def unfilter_lines(lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Pixels of filtered lines; ``above`` is the line before the first. Runs of one filter are undone together."""
    kinds, raw = lines[:, 0], lines[:, 1:]
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError(f"filter {kinds.max()} is not one of the format")
    out = np.empty_like(raw)
    groups = np.minimum(kinds, AVERAGE)  # the last two wait for the same neighbours
    ends = [*(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(kinds)]
    begin = 0
    for end in ends:
        if begin == end:
            continue
        kind, part = int(groups[begin]), raw[begin:end]
        before = out[begin - 1] if begin else above
        if kind == NONE:
            out[begin:end] = part
        elif kind == SUB:
            out[begin:end] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == UP:
            out[begin:end] = np.cumsum(part, axis=0, dtype=np.uint8) + before
        else:
            out[begin:end] = _undo_slanted(part, before, kinds[begin:end] == PAETH)
        begin = end
    return out


def _undo_slanted(raw: np.ndarray, above: np.ndarray, paeth: np.ndarray) -> np.ndarray:
    """Lines filtered by average or Paeth: a pixel waits for those to its left and above, so slanted rows go at once."""
    n, width = raw.shape
    held = np.zeros((n + 1, width + 1), np.int16)  # with the line above, and zeros to the left
    held[0, 1:] = above
    for d in range(n + width - 1):
        y = np.arange(max(0, d - width + 1), min(n, d + 1))
        x = d - y
        left, up, corner = held[y + 1, x], held[y, x + 1], held[y, x]
        guess = np.where(paeth[y], _paeth(left, up, corner), (left + up) >> 1)
        held[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return held[1:, 1:].astype(np.uint8)


def png_encode(pixels: np.ndarray, kinds: tuple[int, ...] = (NONE, SUB, UP), level: int = LEVEL) -> bytes:
    """A grey 8-bit picture as a PNG file."""
    height, width = pixels.shape
    deflate, parts, above = zlib.compressobj(level), [], np.zeros(width, np.uint8)
    for y in range(0, height, LINES):
        part = pixels[y : y + LINES]
        parts.append(deflate.compress(filter_lines(part, above, kinds).tobytes()))
        above = part[-1]
    parts.append(deflate.flush())
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(parts)) + _chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """Pixels of a grey 8-bit, not interlaced PNG file, after testing signature, chunk checksums and length."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, head, stream_, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream_.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not head or not ended or head[2:4] != (8, 0) or head[6]:
        raise ValueError("not a whole grey 8-bit picture")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(stream_))
    except zlib.error as e:
        raise ValueError(f"pixel stream: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("pixel stream of another length")
    return unfilter_lines(np.frombuffer(raw, np.uint8).reshape(height, width + 1), np.zeros(width, np.uint8))


def _cosines(n: int, most: int) -> np.ndarray:
    k, x = np.arange(most)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_LOW = _cosines(32, 8)


def _shrink(values: np.ndarray, axis: int, n: int = 32) -> np.ndarray:
    """Means over n nearly equal runs of an axis; a shorter axis repeats its entries."""
    length = values.shape[axis]
    if length < n:
        return np.take(values, np.arange(n) * length // n, axis=axis)
    edges = np.arange(n) * length // n
    sizes = np.diff(np.append(edges, length))
    sums = np.add.reduceat(values, edges, axis=axis, dtype=np.float64)
    return sums / (sizes[:, None] if axis == 0 else sizes)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits of the low-frequency cosine transform, as 16 hex digits."""
    small = _shrink(_shrink(pixels, 0), 1)
    low = (_LOW @ small @ _LOW.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: str | None, width: int = WIDTH) -> tuple[int, bytes]:
    """Bytes before padding, and the padded bytes."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // width)) * width, b"\0")


def to_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with a binary column that holds ``text`` as a PNG file."""
    if media.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {media} is already there")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, text):
                yield part | {media: [png_encode(np.frombuffer(payload(t)[1], np.uint8).reshape(-1, WIDTH)) for t in part[text]]}

    return stream(df, StructType([*df.schema.fields, StructField(media, BinaryType())]), rows)


def features(stored: DataFrame, *kept: str, media: str = "media") -> DataFrame:
    """``kept`` and, of each picture in the binary column ``media``, its figures and features of its pixels.

    A null picture has null figures; a damaged one raises ValueError.
    """
    out = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kind = StructType([*(stored.schema[c] for c in kept), *StructType.fromDDL(out).fields])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        pixels = png_decode(data)
        back = pixels.tobytes()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, media):
                made = zip(*map(one, part[media]), strict=True)
                yield {c: part[c] for c in kept} | dict(zip(kind.names[len(kept) :], made, strict=True))

    return stream(stored.select(*kept, media), kind, rows)


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, and the features of its text's picture, read from a stored table of pictures."""
    plain = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"))
    stored = materialize(to_media(plain).drop("text"), "media")
    return features(stored, "key", "n_bytes").withColumnRenamed("key", key)
