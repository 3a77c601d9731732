"""Packing of quantiser codes: a top code a window, and codes of patches at several levels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

from loomspan.operators.codec import deltas, undeltas, unzigzag, zigzag

#: Layout, bytes a code, windows, patches, levels.
HEAD = struct.Struct("<BBIHB")
#: How codes lie: as they come, level by level, and level by level as differences along the patches.
FLAT, GROUPED, DELTA = range(3)
MODES = ("flat", "grouped", "optimal")
_PACK = {0: lambda raw: zlib.compress(raw, 9), 1: lambda raw: zstandard.ZstdCompressor(level=19).compress(raw)}
_UNPACK = {0: zlib.decompress, 1: lambda raw: zstandard.ZstdDecompressor().decompress(raw)}


def _laid(top: np.ndarray, bottom: np.ndarray, layout: int) -> bytes:
    kind = np.uint8 if max(top.max(initial=0), bottom.max(initial=0)) < 256 else np.uint16
    top, bottom = top.astype(kind), bottom.astype(kind)
    if layout == DELTA:
        bottom = zigzag(np.ascontiguousarray(deltas(bottom, 1, 1)))
    body = bottom if layout == FLAT else np.moveaxis(bottom, 2, 0)
    return HEAD.pack(layout, np.dtype(kind).itemsize, *bottom.shape) + top.tobytes() + np.ascontiguousarray(body).tobytes()


def pack_codes(top: np.ndarray, bottom: np.ndarray, mode: str = "optimal") -> bytes:
    """``top`` (windows) and ``bottom`` (windows x patches x levels) codes as bytes; optimal: the smallest of four ways."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    if min(top.min(initial=0), bottom.min(initial=0)) < 0 or max(top.max(initial=0), bottom.max(initial=0)) > 65_535:
        raise ValueError("codes are 0 to 65535")
    if mode == "optimal":
        tried = [(layout, p) for layout in (GROUPED, DELTA) for p in _PACK]
    else:
        tried = [(FLAT if mode == "flat" else GROUPED, 0)]
    return min((bytes([p]) + _PACK[p](_laid(top, bottom, layout)) for layout, p in tried), key=len)


def unpack_codes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(top, bottom) of packed codes, however they were packed."""
    raw = _UNPACK[blob[0]](blob[1:])
    layout, width, n, patches, levels = HEAD.unpack_from(raw)
    codes = np.frombuffer(raw, f"<u{width}", offset=HEAD.size)
    top, body = codes[:n], codes[n:]
    if layout == FLAT:
        return top.astype(np.int64), body.reshape(n, patches, levels).astype(np.int64)
    bottom = np.ascontiguousarray(np.moveaxis(body.reshape(levels, n, patches), 0, 2))
    if layout == DELTA:
        bottom = undeltas(unzigzag(bottom), 1, 1)
    return top.astype(np.int64), bottom.astype(np.int64)


def _bits(codes: np.ndarray) -> float:
    counts = np.unique(codes, return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def code_stats(top: np.ndarray, bottom: np.ndarray, raw_window_bytes: int) -> dict:
    """Bytes a window kept plainly, by entropy and by the best packing, and what each saves of ``raw_window_bytes``."""
    n, patches, levels = bottom.shape
    plain = 1 + patches * levels
    levels_bits = [_bits(bottom[:, :, i]) for i in range(levels)]
    ideal = (_bits(top) * n + sum(levels_bits) * n * patches) / 8 / n
    sizes = {m: len(pack_codes(top, bottom, m)) for m in MODES}
    best = min(sizes.values()) / n
    return {"n_windows": n, "plain_bytes": plain, "plain_ratio": raw_window_bytes / plain, "entropy_bytes": ideal, "entropy_ratio": raw_window_bytes / max(ideal, 1e-12), "best_bytes": best, "best_ratio": raw_window_bytes / best, "top_bits": _bits(top), "level_bits": levels_bits, **{f"{m}_size": s for m, s in sizes.items()}}
