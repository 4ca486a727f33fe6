"""Scalar column functions of graph layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 .. to 0, 1, 2, 3 .."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def varint_bytes(x: Column) -> Column:
    """Bytes of a non-negative number at seven bits a byte."""
    return F.when(x == 0, 1).otherwise(F.floor(F.log2(x.cast("double")) / 7) + 1).cast("int")


def gap_bits(gap: Column) -> Column:
    """1 + floor(log2 max(1, gap))."""
    return 1 + F.floor(F.log2(F.greatest(gap, F.lit(1)).cast("double")))


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Bits of x and y interleaved, x in the even places."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        a = F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i)
        b = F.shiftleft(F.shiftright(y.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i + 1)
        out = out.bitwiseOR(a).bitwiseOR(b)
    return out


def hilbert_sql(x: str, y: str, bits: int = 16) -> str:
    """SQL: the distance of (x, y) along the Hilbert curve of 2^bits a side."""
    n = 1 << bits
    start = f"named_struct('x', cast({x} as long), 'y', cast({y} as long), 'd', 0L)"
    rx, ry = "if((a.x & s) > 0, 1L, 0L)", "if((a.y & s) > 0, 1L, 0L)"
    flip = f"if({ry} = 0 and {rx} = 1"
    nx, ny = f"{flip}, {n - 1}L - a.x, a.x)", f"{flip}, {n - 1}L - a.y, a.y)"
    turned = f"named_struct('x', if({ry} = 0, {ny}, {nx}), 'y', if({ry} = 0, {nx}, {ny}), 'd', a.d + s * s * ((3L * {rx}) ^ {ry}))"
    return f"aggregate(transform(sequence({bits - 1}, 0), i -> shiftleft(1L, i)), {start}, (a, s) -> {turned}, a -> a.d)"


def hilbert(x: str, y: str, bits: int = 16) -> Column:
    return F.expr(hilbert_sql(x, y, bits))


def mixed(*columns: Column | str, seed: int = 0) -> Column:
    """A hash of the columns as a non-negative long."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 63) - 1))
