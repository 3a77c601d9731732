"""Block compression of float arrays: exact and lossy modes, and a competition of transforms and compressors.

A block is one row: windows x steps x features of float32 (or of a 16-bit float kept as its bits) in one array. Kernels
are NumPy inside Arrow batches; a block never leaves its row, so nothing is shuffled. Blobs carry their own header and
are decoded without other columns; the winner and the sizes of a competition stand in the header's front.
"""

from __future__ import annotations

import gzip
import io
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from loomspan.operators import entropy

MODES = ("lossless", "lossless_zstd", "lossless_lzma", "lossless_fast", "near_lossless", "near_lossless_turbo", "normalized_lossless", "normalized_lossless_zstd", "quantized_8", "optimal", "optimal_fast", "gorilla", "chimp", "raw")
EXACT = ("lossless", "lossless_zstd", "lossless_lzma", "lossless_fast", "optimal", "optimal_fast", "gorilla", "chimp", "raw")
#: Element kinds by code: float32, float16, and bfloat16 as its bits.
KINDS = (np.dtype(np.float32), np.dtype(np.float16), np.dtype(np.uint16))
#: Mode, kind, windows, steps, features.
HEAD = struct.Struct("<BBIII")
#: Candidates of the screened competition.
SCREENED = 4


def planes(a: np.ndarray) -> bytes:
    """The k-th bytes of all elements together, for each k."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if len(raw) % size:
        raise ValueError(f"{len(raw)} bytes are no whole elements of {size}")
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def deltas(u: np.ndarray, order: int, axis: int = -2) -> np.ndarray:
    """Differences along an axis (the steps), wrapping; the first ones are differences of lower order."""
    if axis == -2:  # without moving axes, which costs more than the differences of a small block
        out = u.copy()
        for j in range(order):
            out[..., j + 1 :, :] = out[..., j + 1 :, :] - out[..., j:-1, :]
        return out
    out = np.moveaxis(u.copy(), axis, 0)
    for j in range(order):
        out[j + 1 :] = out[j + 1 :] - out[j:-1]
    return np.moveaxis(out, 0, axis)


def undeltas(d: np.ndarray, order: int, axis: int = -2) -> np.ndarray:
    out = np.moveaxis(d.copy(), axis, 0)
    for j in reversed(range(order)):
        out[j:] = np.cumsum(out[j:], axis=0, dtype=out.dtype)
    return np.moveaxis(out, 0, axis)


def xors(u: np.ndarray) -> np.ndarray:
    out = u.copy()
    out[..., 1:, :] ^= u[..., :-1, :]
    return out


def unxors(d: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.accumulate(d, axis=-2)


def zigzag(u: np.ndarray) -> np.ndarray:
    """Small differences of either sign as small numbers, at the width of ``u``."""
    s = u.view(np.dtype(f"i{u.itemsize}"))
    return ((s << 1) ^ (s >> (8 * u.itemsize - 1))).view(u.dtype)


def unzigzag(z: np.ndarray) -> np.ndarray:
    one = z.dtype.type(1)
    return (z >> one) ^ (z.dtype.type(0) - (z & one))


def flat(u: np.ndarray) -> np.ndarray:
    """All windows as one."""
    return u.reshape(1, -1, u.shape[-1])


def _fields(u: np.ndarray) -> bytes:
    return planes((u >> np.uint32(23)).astype(np.uint16).ravel()) + planes((u & np.uint32(0x7FFFFF)).ravel())


def _unfields(raw: bytes, n: int) -> np.ndarray:
    return (unplanes(raw[: 2 * n], np.uint16).astype(np.uint32) << np.uint32(23)) | unplanes(raw[2 * n :], np.uint32)


def _best_orders(u: np.ndarray) -> list[int]:
    """For each feature the order of least absolute sum, the smallest of equals."""
    signed = np.dtype(f"i{u.itemsize}")
    sums = [np.abs(np.ascontiguousarray(deltas(u, k)).view(signed).astype(np.int64)).sum(axis=(0, 1)) for k in range(min(5, u.shape[1]))]
    return np.argmin(np.stack(sums), axis=0).tolist()


def _adaptive(u: np.ndarray) -> bytes:
    orders = _best_orders(u)
    cols = [deltas(u[..., [i]], k) for i, k in enumerate(orders)]
    return bytes(orders) + planes(np.concatenate(cols, axis=-1).ravel())


def _unadaptive(raw: bytes, shape: tuple) -> np.ndarray:
    f = shape[-1]
    d = unplanes(raw[f:], np.uint32).reshape(shape)
    return np.concatenate([undeltas(d[..., [i]], k) for i, k in enumerate(raw[:f])], axis=-1)


def _across(u: np.ndarray) -> np.ndarray:
    out = u.copy()
    out[..., 1:] -= u[..., :-1]
    out[..., [0]] = deltas(u[..., [0]], 1)
    return out


def _unacross(d: np.ndarray) -> np.ndarray:
    out = d.copy()
    out[..., [0]] = undeltas(d[..., [0]], 1)
    return np.cumsum(out, axis=-1, dtype=out.dtype)


def _forth(f: Callable, pack: Callable = lambda x: planes(x.ravel())) -> Callable:
    return lambda u: pack(np.ascontiguousarray(f(u)))


def _back(f: Callable, split: bool = True) -> Callable:
    """Inverse that undoes ``f`` on the elements of a shape; ``split``: they were parted into planes."""
    return lambda raw, shape, kind=np.uint32: f((unplanes(raw, kind) if split else np.frombuffer(raw, kind)).reshape(shape))


def _pair(forth: Callable, back: Callable, split: bool = True) -> tuple[Callable, Callable]:
    return _forth(forth, (lambda x: planes(x.ravel())) if split else (lambda x: x.tobytes())), _back(back, split)


def _same(x: np.ndarray) -> np.ndarray:
    return x


#: Reversible transforms by id: bytes of the bits (windows x steps x features of unsigned integers), and back.
TRANSFORMS = {
    0: _pair(_same, _same),
    **{k: _pair(lambda u, k=k: deltas(u, k), lambda d, k=k: undeltas(d, k)) for k in (1, 2, 3, 4)},
    5: _pair(xors, unxors),
    6: (_adaptive, lambda raw, shape, kind=np.uint32: _unadaptive(raw, shape)),
    7: _pair(_across, _unacross),
    8: _pair(lambda u: zigzag(deltas(u, 1)), lambda d: undeltas(unzigzag(d), 1)),
    9: _pair(lambda u: zigzag(deltas(u, 2)), lambda d: undeltas(unzigzag(d), 2)),
    10: _pair(_same, _same, False),
    11: _pair(lambda u: deltas(u, 1), lambda d: undeltas(d, 1), False),
    12: (_fields, lambda raw, shape, kind=np.uint32: _unfields(raw, int(np.prod(shape))).reshape(shape)),
    13: _pair(lambda u: zigzag(deltas(flat(u), 1)), lambda d: undeltas(flat(unzigzag(d)), 1).reshape(d.shape)),
    14: _pair(lambda u: zigzag(deltas(deltas(u, 1, 0), 1)), lambda d: undeltas(undeltas(unzigzag(d), 1), 1, 0)),
    15: _pair(lambda u: deltas(flat(u), 1), lambda d: undeltas(flat(d), 1).reshape(d.shape), False),
    16: _pair(lambda u: deltas(flat(u), 1), lambda d: undeltas(flat(d), 1).reshape(d.shape)),
}
#: The transforms that compete for each element size.
RIVALS = {4: (*range(16),), 2: (0, 1, 16, 10)}


def _quarters(pack, raw: bytes, most: float = float("inf")) -> bytes | None:
    """Four parts packed one by one; None once they are sure to have more than ``most`` bytes (a part has 8 at least)."""
    parts, size = [], 16 + 4 * 8
    for i in range(4):
        parts.append(pack(raw[i * len(raw) // 4 : (i + 1) * len(raw) // 4]))
        size += len(parts[-1]) - 8
        if size > most:
            return None
    return struct.pack("<4I", *map(len, parts)) + b"".join(parts)


def _unquarters(unpack, raw: bytes) -> bytes:
    sizes, at, out = struct.unpack_from("<4I", raw), 16, []
    for n in sizes:
        out.append(unpack(raw[at : at + n]))
        at += n
    return b"".join(out)


@lru_cache(maxsize=None)
def _zstd_own(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@lru_cache(maxsize=None)
def _unzstd_own() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _zstd(level: int):
    return lambda raw: _zstd_own(level).compress(raw)


def _unzstd(raw: bytes) -> bytes:
    return _unzstd_own().decompress(raw)


def _lzma(level: int):
    def pack(raw: bytes) -> bytes:
        # a dictionary no larger than the block: setting up the preset's own costs more than packing
        return lzma.compress(raw, format=lzma.FORMAT_XZ, filters=[{"id": lzma.FILTER_LZMA2, "preset": level, "dict_size": min(1 << 26, max(4096, len(raw)))}])

    return pack


#: Byte compressors by id.
COMPRESSORS = {
    0: (lambda raw: zlib.compress(raw, 9), zlib.decompress),
    1: (_zstd(22), _unzstd),
    2: (_lzma(9), lzma.decompress),
    3: (lambda raw, most=float("inf"): _quarters(lambda x: zlib.compress(x, 9), raw, most), lambda raw: _unquarters(zlib.decompress, raw)),
    4: (lambda raw: _quarters(_lzma(9), raw), lambda raw: _unquarters(lzma.decompress, raw)),
}


def _least(compressor: int, n: int) -> int:
    """Bytes that a compressor's output of ``n`` bytes has at least.

    An xz stream has headers of 12 + 12, a check of 8, an index of 8, a footer of 12 and, in fours, a block: a plain chunk
    of 3 + n + 1 bytes, or a coded one of 6 + 5 + 1 or more. Without content it is a header, index and footer. A zlib
    stream has 2 + 4 bytes and 2 or more of content.
    """
    if compressor == 2:
        return 52 + (8 if n < 5 else 12) if n else 32
    if compressor == 4:
        return 16 + sum(_least(2, (i + 1) * n // 4 - i * n // 4) for i in range(4))
    return {0: 8, 3: 16 + 4 * 8}.get(compressor, 0)


def compete(u: np.ndarray, fast: bool) -> bytes:
    """Transform, compressor and bytes of the smallest candidate, ties to the smaller ids.

    ``fast`` packs only the ``SCREENED`` best after a screening with a quick compressor, and the identity.
    """
    made = {i: TRANSFORMS[i][0](u) for i in RIVALS[u.itemsize]}
    sizes = {raw: len(zlib.compress(raw, 6)) for raw in set(made.values())} if fast else {}
    tried = sorted(made, key=lambda i: (sizes[made[i]], i))[:SCREENED] if fast else list(made)
    packs = (0, 1, 2, 3) if fast else COMPRESSORS
    # of transforms that give the same bytes the smallest id wins its ties, so the others need no packing
    first: dict[bytes, int] = {}
    for t in sorted({*tried, 10}):
        first.setdefault(made[t], t)
    best = None
    for c in packs:
        for raw, t in first.items():
            if best and best[0] < _least(c, len(raw)):
                continue  # no output of this compressor is as small
            packed = COMPRESSORS[c][0](raw, best[0]) if c == 3 and best else COMPRESSORS[c][0](raw)
            if packed is None:
                continue
            if best is None or (len(packed), t, c) < best[:3]:
                best = len(packed), t, c, packed
    return bytes(best[1:3]) + best[3]


def screening(u: np.ndarray) -> list[tuple[int, int]]:
    """(transform, size after a quick compressor), the smallest first."""
    return sorted(((t, len(zlib.compress(TRANSFORMS[t][0](u), 6))) for t in RIVALS[u.itemsize]), key=lambda x: (x[1], x[0]))


class BitWriter:
    def __init__(self):
        self.value, self.size = 1, 0

    def put(self, value: int, bits: int) -> None:
        self.value = (self.value << bits) | value
        self.size += bits

    def done(self) -> bytes:
        spare = -self.size % 8
        raw = (self.value << spare).to_bytes((self.size + spare) // 8 + 1, "big")
        return raw[1:]

    def spill(self, parts: list[bytes], most: int = 1 << 14) -> None:
        """Move whole bytes to ``parts`` once there are many bits."""
        if self.size > most:
            keep = self.size % 8
            body = self.value ^ (1 << self.size)
            parts.append((body >> keep).to_bytes(self.size // 8, "big"))
            self.value, self.size = (1 << keep) | (body & ((1 << keep) - 1)), keep


class BitReader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def get(self, bits: int) -> int:
        a, b = self.at // 8, (self.at + bits + 7) // 8
        self.at += bits
        return (int.from_bytes(self.raw[a:b], "big") >> (b * 8 - self.at)) & ((1 << bits) - 1)


def gorilla_code(values: list[int]) -> bytes:
    """32-bit words, each XORed with the one before: a bit for none, the last bit window again, or a new window.

    Control bits 0: equal; 10: within the last window; 11: five bits of leading zeros, six of the width less one.
    """
    out, parts, lead, trail = BitWriter(), [], 0, 0
    for i, v in enumerate(values):
        if not i:
            out.put(v, 32)
            continue
        x = v ^ values[i - 1]
        if not x:
            out.put(0, 1)
            continue
        zeros, low = 32 - x.bit_length(), (x & -x).bit_length() - 1
        if lead + trail and zeros >= lead and low >= trail:
            out.put(0b10, 2)
            out.put(x >> trail, 32 - lead - trail)
        else:
            lead, trail = zeros, low
            out.put(0b11, 2)
            out.put(lead, 5)
            out.put(32 - lead - trail - 1, 6)
            out.put(x >> trail, 32 - lead - trail)
        out.spill(parts)
    return b"".join([*parts, out.done()])


def gorilla_decode(raw: bytes, n: int) -> list[int]:
    read, out, trail, width = BitReader(raw), [], 0, 32
    for i in range(n):
        if not i:
            out.append(read.get(32))
        elif not read.get(1):
            out.append(out[-1])
        else:
            if read.get(1):
                lead, width = read.get(5), read.get(6) + 1
                trail = 32 - lead - width
            out.append(out[-1] ^ (read.get(width) << trail))
    return out


def xor_code(values: list[int], reach: int) -> bytes:
    """Each value XORed with one of the last ``reach`` (the one leaving most leading zeros), zero or a bit window."""
    out, pick, parts = BitWriter(), (reach - 1).bit_length(), []
    for i, v in enumerate(values):
        if i:
            back = min(range(1, min(reach, i) + 1), key=lambda j: ((v ^ values[i - j]).bit_length(), j))
            x = v ^ values[i - back]
            out.put(back - 1, pick)
            if not x:
                out.put(0, 1)
            else:
                trail = (x & -x).bit_length() - 1
                width = x.bit_length() - trail
                out.put(1, 1)
                out.put(32 - x.bit_length(), 5)
                out.put(width - 1, 5)
                out.put(x >> trail, width)
        else:
            out.put(v, 32)
        out.spill(parts)
    return b"".join([*parts, out.done()])


def xor_decode(raw: bytes, n: int, reach: int) -> list[int]:
    read, pick, out = BitReader(raw), (reach - 1).bit_length(), []
    for i in range(n):
        if not i:
            out.append(read.get(32))
            continue
        base = out[i - 1 - (read.get(pick) if pick else 0)]
        if not read.get(1):
            out.append(base)
            continue
        lead, width = read.get(5), read.get(5) + 1
        out.append(base ^ (read.get(width) << (32 - lead - width)))
    return out


def _scaled(a: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = a.min(axis=(0, 1)).astype(np.float64)
    span = np.maximum(a.max(axis=(0, 1)).astype(np.float64) - lo, floor)
    return (a - lo) / span, lo, span


def shaped(a: np.ndarray) -> np.ndarray:
    """Any rank as windows x steps x features: one value a step, or rows of one window, or trailing axes as features."""
    if a.ndim < 2:
        return a.reshape(1, -1, 1)
    return a.reshape(1, *a.shape) if a.ndim == 2 else a.reshape(*a.shape[:2], -1)


def encode(a: np.ndarray, mode: str) -> bytes:
    """A block as a blob; arrays of other kinds than a float of 16 or 32 bits (uint16: bfloat16 bits) become float32."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    if not a.size:
        raise ValueError("an empty block")
    kind = KINDS.index(a.dtype) if a.dtype in KINDS else 0
    if kind and mode not in EXACT:
        raise ValueError(f"mode {mode!r} takes float32 only")
    a = np.ascontiguousarray(shaped(a), KINDS[kind])
    u = a.view(np.dtype(f"u{a.itemsize}"))
    if mode == "lossless":
        body = zlib.compress(planes(u.ravel()), 6)
    elif mode == "lossless_zstd":
        body = _zstd(19)(planes(u.ravel()))
    elif mode == "lossless_lzma":
        body = _lzma(6)(planes(u.ravel()))
    elif mode == "lossless_fast":
        body = _zstd(3)(planes(deltas(flat(u), 1).ravel()))
    elif mode in ("optimal", "optimal_fast"):
        body = compete(u, mode == "optimal_fast")
    elif mode == "gorilla":
        body = gorilla_code(u.ravel().tolist())
    elif mode == "chimp":
        body = xor_code(u.ravel().tolist(), 8)
    elif mode == "raw":
        body = pack_bytes(a.tobytes())
    else:
        x, lo, span = _scaled(a, 1e-30 if mode.startswith("normalized") else 1e-10)
        head = lo.tobytes() + span.tobytes()
        if mode == "near_lossless":
            body = head + zlib.compress(x.astype(np.float16).tobytes(), 6)
        elif mode == "near_lossless_turbo":
            body = head + zlib.compress(planes(x.astype(np.float16).ravel()), 1)
        elif mode == "quantized_8":
            body = head + zlib.compress(deltas(np.clip(x * 255, 0, 255).astype(np.uint8), 1).tobytes(), 6)
        else:
            raw = planes(x.astype(np.float32).ravel())
            body = head + (_zstd(19)(raw) if mode.endswith("zstd") else zlib.compress(raw, 6))
    return HEAD.pack(MODES.index(mode), kind, *a.shape) + body


def decode(blob: bytes, wide: bool = False) -> np.ndarray:
    """Windows x steps x features; ``wide`` gives lossy modes as the float64 they are computed in."""
    mode, kind, *shape = HEAD.unpack_from(blob)
    mode, kind, body, n = MODES[mode], KINDS[kind], blob[HEAD.size :], int(np.prod(shape))
    bits = np.dtype(f"u{kind.itemsize}")
    if mode in ("lossless", "lossless_zstd", "lossless_lzma"):
        unpack = {"lossless": zlib.decompress, "lossless_zstd": _unzstd, "lossless_lzma": lzma.decompress}[mode]
        return unplanes(unpack(body), kind).reshape(shape)
    if mode == "lossless_fast":
        return undeltas(unplanes(_unzstd(body), bits).reshape(1, -1, shape[2]), 1).view(kind).reshape(shape)
    if mode in ("optimal", "optimal_fast"):
        return np.ascontiguousarray(TRANSFORMS[body[0]][1](COMPRESSORS[body[1]][1](body[2:]), tuple(shape), bits)).view(kind)
    if mode in ("gorilla", "chimp"):
        found = gorilla_decode(body, n) if mode == "gorilla" else xor_decode(body, n, 8)
        return np.array(found, np.uint32).astype(bits).view(kind).reshape(shape)
    if mode == "raw":
        return np.frombuffer(unpack_bytes(body), kind).reshape(shape)
    f = shape[2]
    lo, span, rest = np.frombuffer(body[: 8 * f]), np.frombuffer(body[8 * f : 16 * f]), body[16 * f :]
    if mode == "near_lossless":
        x = np.frombuffer(zlib.decompress(rest), np.float16).reshape(shape)
    elif mode == "near_lossless_turbo":
        x = unplanes(zlib.decompress(rest), np.float16).reshape(shape)
    elif mode == "quantized_8":
        x = undeltas(np.frombuffer(zlib.decompress(rest), np.uint8).reshape(shape), 1) / 255
    else:
        x = unplanes((_unzstd if mode.endswith("zstd") else zlib.decompress)(rest), np.float32).reshape(shape)
    back = x.astype(np.float64) * span + lo
    return back if wide else back.astype(np.float32)


#: Byte packers of raw files by tag.
PACKERS = {b"z": (lambda raw: zlib.compress(raw, 9), zlib.decompress), b"s": (_zstd(19), _unzstd), b"l": (_lzma(6), lzma.decompress)}


def pack_bytes(raw: bytes) -> bytes:
    """Any bytes by the packer that makes them smallest, its tag first."""
    best = b""
    for tag, (pack, _) in PACKERS.items():
        if best and tag == b"l" and len(best) <= 1 + _least(2, len(raw)):
            continue
        packed = tag + pack(raw)
        best = packed if not best or len(packed) < len(best) else best
    return best


def unpack_bytes(blob: bytes) -> bytes:
    return PACKERS[blob[:1]][1](blob[1:])


def widen_bfloat16(bits: np.ndarray) -> np.ndarray:
    """float32 of bfloat16 bits."""
    return (bits.astype(np.uint32) << np.uint32(16)).view(np.float32)


def xor_residual(a: np.ndarray, near: np.ndarray) -> bytes:
    """What bits of ``a`` differ from an approximation, packed; with the same approximation it gives ``a`` back."""
    bits = np.ascontiguousarray(a, np.float32).view(np.uint32) ^ np.ascontiguousarray(near, np.float32).view(np.uint32)
    return zlib.compress(planes(bits.ravel()), 6)


def xor_restore(blob: bytes, near: np.ndarray) -> np.ndarray:
    near = np.ascontiguousarray(near, np.float32)
    return (unplanes(zlib.decompress(blob), np.uint32).reshape(near.shape) ^ near.view(np.uint32)).view(np.float32)


def certificate(blob: bytes) -> dict:
    """What a competition's blob says about itself and how near it is to the entropy of its transformed bytes."""
    mode, kind, *shape = HEAD.unpack_from(blob)
    if MODES[mode] not in ("optimal", "optimal_fast"):
        raise ValueError(f"a blob of mode {MODES[mode]!r} has no certificate")
    t, c, packed = blob[HEAD.size], blob[HEAD.size + 1], blob[HEAD.size + 2 :]
    raw = np.frombuffer(COMPRESSORS[c][1](packed), np.uint8)
    h0, h1 = entropy.byte_entropy(raw), entropy.byte_context_entropy(raw)
    floor, achieved = min(h0, h0 if h1 is None else h1), 8 * len(packed) / max(len(raw), 1)
    size = int(np.prod(shape)) * KINDS[kind].itemsize
    over = max(achieved - floor, 0.0)
    return {"transform": t, "compressor": c, "original_size": size, "compressed_size": len(packed), "ratio": size / max(len(packed), 1), "entropy": floor, "achieved_bpb": achieved, "gap_bpb": over, "gap_pct": over / floor * 100 if floor > 0 else 0.0, "p_value": entropy.chi_squared_p(np.frombuffer(packed, np.uint8))}


CERTIFICATE = "transform int, compressor int, original_size long, compressed_size long, ratio double, entropy double, achieved_bpb double, gap_bpb double, gap_pct double, p_value double"


def finite(a: np.ndarray) -> np.ndarray:
    """NaN as 0 and infinities as the largest numbers of the type."""
    return np.nan_to_num(a, nan=0.0)


def _by_row(df: DataFrame, kind: StructType, name: str, rows: Callable[[pa.Array], list]) -> DataFrame:
    """``df`` with the column ``name`` replaced by columns that ``rows`` makes of it, an Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            made = rows(batch.column(name))
            kept = [batch.column(c) for c in batch.schema.names if c != name]
            cols = [*kept, *(pa.array(c, type=arrow.field(len(kept) + i).type) for i, c in enumerate(made))]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def compress(blocks: DataFrame, mode: str, features: int = 1, values: str = "values", on_nonfinite: str = "replace", steps: int | None = None) -> DataFrame:
    """``blocks`` with mode, raw_bytes and blob in place of ``values`` (ARRAY<FLOAT>, row by row, windows of ``steps``).

    Null and empty arrays have a null blob.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")

    def rows(column: pa.Array) -> list:
        flat_, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32), np.cumsum(column.value_lengths().fill_null(0).to_numpy())
        flat_ = finite(flat_) if on_nonfinite == "replace" else flat_
        out, begin = [], 0
        for end in ends.tolist():
            part = flat_[begin:end]
            if len(part) % ((steps or 1) * features):
                raise ValueError(f"{len(part)} values are no whole windows of {steps or 1} steps and {features} features")
            out.append(encode(part.reshape(-1, steps or len(part) // features, features), mode) if len(part) else None)
            begin = end
        return [out]

    plain = blocks.withColumns({"mode": F.lit(mode), "raw_bytes": F.coalesce(F.size(values), F.lit(0)).cast("long") * 4, values: F.col(values).cast("array<float>")})
    kind = StructType([*(f for f in plain.schema.fields if f.name != values), *StructType.fromDDL("blob binary").fields])
    return _by_row(plain, kind, values, rows)


def sizes(blocks: DataFrame, modes: tuple[str, ...] = MODES, features: int = 1, values: str = "values") -> DataFrame:
    """(mode, raw_bytes, blob_bytes): sums over the blocks of each Arrow batch, every mode in one pass over the blocks.

    Null and empty arrays have no blob.
    """
    kind = to_arrow_schema(StructType.fromDDL("mode string, raw_bytes long, blob_bytes long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [finite(np.array(v, np.float32)).reshape(-1, features) for v in batch.column(0).to_pylist() if v]
            raw = sum(r.nbytes for r in rows)
            made = [sum(len(encode(r[None], m)) for r in rows) for m in modes]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip((modes, [raw] * len(modes), made), kind.types, strict=True)], schema=kind)

    return blocks.select(F.col(values).cast("array<float>")).mapInArrow(run, "mode string, raw_bytes long, blob_bytes long")


def decompress(blobs: DataFrame, blob: str = "blob", values: str = "values", wide: bool = False) -> DataFrame:
    """``blobs`` with the decoded ``values`` in place of ``blob``, as ARRAY<DOUBLE> where ``wide``."""
    kind = StructType([*(f for f in blobs.schema.fields if f.name != blob), StructField(values, ArrayType(DoubleType() if wide else FloatType()))])

    def rows(column: pa.Array) -> list:
        made = [None if b is None else decode(b, wide) for b in column.to_pylist()]
        return [[None if a is None else _as_float(a, wide).ravel() for a in made]]

    return _by_row(blobs, kind, blob, rows)


def _as_float(a: np.ndarray, wide: bool = False) -> np.ndarray:
    return (widen_bfloat16(a) if a.dtype == np.uint16 else a).astype(np.float64 if wide else np.float32)


def certified(blobs: DataFrame, blob: str = "blob") -> DataFrame:
    """``blobs`` with certificate columns beside ``blob``; a reader of the columns alone never touches the blobs."""
    kept = blobs.withColumn("_certified", F.col(blob))
    kind = StructType([*(f for f in kept.schema.fields if f.name != "_certified"), *StructType.fromDDL(CERTIFICATE).fields])
    names = [f.name for f in StructType.fromDDL(CERTIFICATE).fields]

    def rows(column: pa.Array) -> list:
        made = [None if b is None else certificate(b) for b in column.to_pylist()]
        return [[None if m is None else m[n] for m in made] for n in names]

    return _by_row(kept, kind, "_certified", rows)


def compress_optimal(blocks: DataFrame, features: int = 1, fast: bool = False, values: str = "values", steps: int | None = None) -> DataFrame:
    """Blobs of the competition with their certificates, from one run of it."""
    return certified(compress(blocks, "optimal_fast" if fast else "optimal", features, values, steps=steps))


def candidates(blocks: DataFrame, features: int = 1, values: str = "values") -> DataFrame:
    """``blocks`` with transform, size and rnk: each transform's size after a quick compressor, the smallest first."""
    kind = StructType([*(f for f in blocks.schema.fields if f.name != values), *StructType.fromDDL("found array<struct<transform: int, size: int>>").fields])

    def rows(column: pa.Array) -> list:
        out = []
        for v in column.to_pylist():
            u = np.ascontiguousarray(shaped(np.array(v, np.float32).reshape(-1, features))).view(np.uint32)
            out.append([{"transform": t, "size": n} for t, n in screening(u)])
        return [out]

    found = _by_row(blocks.withColumn(values, F.col(values).cast("array<float>")), kind, values, rows)
    kept = [c for c in blocks.columns if c != values]
    return found.select(*kept, F.posexplode("found").alias("rnk", "f")).select(*kept, "rnk", "f.transform", "f.size")


def reference_sizes(a: np.ndarray) -> dict[str, int]:
    """Bytes of plain ways to keep a table: raw, and its CSV text by gzip 9 and zstd 22."""
    text = io.StringIO()
    np.savetxt(text, a.reshape(-1, a.shape[-1]), delimiter=",", fmt="%.9g")
    csv = text.getvalue().encode()
    return {"raw": a.nbytes, "csv": len(csv), "csv_gzip": len(gzip.compress(csv, 9)), "csv_zstd": len(_zstd(22)(csv))}
