"""256-bit amounts as eight limbs of 32 bits in longs, low limb first; the last limb holds the sign of a normalised amount.

A limb of a normalised amount is below 2**32 in size, so a long sums 2**31 of them without overflow; Spark's ANSI sums raise an
error beyond that, they don't wrap. Sums, carries and order stay in generated code; only decimal text leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LIMBS = tuple(f"l{k}" for k in range(8))
LOW = (1 << 32) - 1
KIND = "bigint"


def of(limb: Callable[[str], Column]) -> Column:
    return F.struct(*[limb(n).alias(n) for n in LIMBS])


def zero() -> Column:
    return F.lit(0).cast(KIND)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written down and computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def from_hex(c: Column, bad_is_zero: bool = True) -> Column:
    """0x-hex of up to 64 digits; empty counts as zero, malformed text as zero or null."""
    good = F.coalesce(c.rlike(r"\A(0[xX])?[0-9a-fA-F]{0,64}\z"), F.lit(False))
    full = F.lpad(F.substring_index(F.lower(c), "x", -1), 64, "0")
    # most digits of most amounts are zeros, which need no conversion
    limb = lambda t: F.when(t == "0" * 8, zero()).otherwise(F.conv(t, 16, 10).cast(KIND))
    limbs = let(full, lambda t: F.struct(*[limb(F.substring(t, 57 - 8 * k, 8)).alias(n) for k, n in enumerate(LIMBS)]))
    return F.when(good, limbs).otherwise(of(lambda _: zero())) if bad_is_zero else F.when(good, limbs)


def from_long(c: Column) -> Column:
    """A signed bigint as raw limbs (the second one signed; call ``normalise`` after sums)."""
    c = c.cast(KIND)
    return F.struct(c.bitwiseAND(F.lit(LOW)).alias("l0"), F.shiftright(c, 32).alias("l1"), *[zero().alias(n) for n in LIMBS[2:]])


def negate(u: Column) -> Column:
    return of(lambda n: -u[n])


def minus(a: Column, b: Column) -> Column:
    """Raw limbs of a difference; normalise afterwards."""
    return of(lambda n: a[n] - b[n])


def sum_of(u: Column, over=None) -> Column:
    """Limb sums, plain or over a window; normalise afterwards."""
    return of(lambda n: F.sum(u[n]) if over is None else F.sum(u[n]).over(over))


def signed_sum_of(u: Column, minus: Column) -> Column:
    """Limb sums where rows with ``minus`` count negative; normalise afterwards."""
    return of(lambda n: F.sum(F.when(minus, -u[n]).otherwise(u[n])))


def normalise(u: Column) -> Column:
    """Carry upwards: all limbs but the last come to 0..2**32-1, the last holds the sign."""

    def carried(x: Column) -> Column:
        out, carry = [], zero()
        for n in LIMBS[:-1]:
            limb = x[n] + carry
            out.append(limb.bitwiseAND(F.lit(LOW)).alias(n))
            carry = F.shiftright(limb, 32)
        return F.struct(*out, (x[LIMBS[-1]] + carry).alias(LIMBS[-1]))

    return let(u, carried)


def sign(u: Column) -> Column:
    """-1, 0 or 1 of a normalised amount."""

    def of_limbs(x: Column) -> Column:
        some = x[LIMBS[0]]
        for n in LIMBS[1:]:
            some = some.bitwiseOR(x[n])
        return F.when(x[LIMBS[-1]] < 0, -1).when(some == 0, 0).otherwise(1)

    return let(u, of_limbs)


def to_double(u: Column) -> Column:
    """About the nearest double of a normalised amount; a negative one is turned first, so small ones stay exact."""

    def plain(x: Column) -> Column:
        pair = lambda k: x[LIMBS[k]].cast("double") + x[LIMBS[k + 1]].cast("double") * float(1 << 32)
        return pair(0) + pair(2) * float(1 << 64) + pair(4) * float(1 << 128) + pair(6) * float(1 << 192)

    return let(u, lambda x: F.when(x[LIMBS[-1]] < 0, -let(normalise(negate(x)), plain)).otherwise(plain(x)))


def order_key(u: Column) -> Column:
    return F.struct(*[u[n] for n in reversed(LIMBS)])


@F.pandas_udf(StringType())
def _text(*limbs):  # noqa: ANN002, ANN202
    known = ~limbs[0].isna().to_numpy()
    parts = [x.fillna(0).to_numpy(np.int64) for x in limbs]
    low = parts[1] << 32 | parts[0]
    out = low.astype(object)
    # amounts of 63 bits are texts at once, of either sign; the others one by one
    fill = low >> 63
    short = (parts[7] == fill) & np.logical_and.reduce([p == (fill & LOW) for p in parts[2:7]])
    out[short] = low[short].astype(str)
    for i in np.flatnonzero(~short):
        out[i] = str(sum(int(p[i]) << 32 * k for k, p in enumerate(parts)))
    out[~known] = None
    return limbs[0].__class__(out, dtype=object)


def to_string(u: Column) -> Column:
    """Decimal text; the one step that leaves the JVM."""
    return _text(*[u[n] for n in LIMBS])


@F.pandas_udf(StringType())
def _hex(text):  # noqa: ANN001, ANN202
    return text.__class__([hex(n) if t is not None and (n := int(t)) < 1 << 256 else None for t in text], dtype=object)


def from_string(c: Column) -> Column:
    """Amount of a strict decimal text (no sign, dot or leading zero); null for any other text and from 2**256 on."""
    strict = F.when(c.rlike(r"^(0|[1-9][0-9]{0,77})\z"), c)
    return from_hex(_hex(strict), bad_is_zero=False)
