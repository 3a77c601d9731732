"""Integer and bit functions; 32-bit results are computed in 64 bits and wrapped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap32(x: Column) -> Column:
    """The signed 32-bit integer that ``x`` is modulo 2^32."""
    return (x + F.lit(1 << 31)).bitwiseAND((1 << 32) - 1) - F.lit(1 << 31)


def unsigned32(x: Column) -> Column:
    return x.cast("long").bitwiseAND((1 << 32) - 1)


def zigzag(x: Column) -> Column:
    """Small magnitudes of either sign to small non-negative numbers (32 bits)."""
    x = x.cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63)).bitwiseAND((1 << 32) - 1)


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(1)))


def leading_zeros(u: Column) -> Column:
    """Of an unsigned 32-bit number."""
    return F.when(u == 0, F.lit(32)).otherwise(F.lit(32) - F.length(F.bin(u)))


def trailing_zeros(u: Column) -> Column:
    return F.when(u == 0, F.lit(32)).otherwise(F.bit_count(u.bitwiseAND(-u) - 1))


def sign_exponent(bits: Column) -> Column:
    return F.shiftrightunsigned(unsigned32(bits), 23)


def mantissa(bits: Column) -> Column:
    return unsigned32(bits).bitwiseAND((1 << 23) - 1)
