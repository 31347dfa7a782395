"""Sums of single-precision numbers that lose nothing: the same for any order and any division of the rows.

A finite float is a whole multiple of 2**-149 below 2**128, so 277 binary digits hold it. They are kept as ``LIMBS`` whole numbers of
``WIDTH`` digits each; a sum adds up the limbs as longs, before the shuffle as well, and two sums are merged by adding theirs. A limb
has room for 2**35 rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, LOWEST, LIMBS = 28, -149, 10
DIGITS = 52  # a float's 24 digits lie within so many of a limb's lowest one

_STATE = "struct<carry:bigint,digits:array<bigint>>"


def weight(limb: int) -> float:
    return 2.0 ** (LOWEST + WIDTH * limb)


def limb_names(name: str) -> list[str]:
    return [f"{name}_{k}" for k in range(LIMBS)]


def limbs(value: Column) -> list[Column]:
    """The limbs of a finite float, with its sign, as longs. Every step is exact: scaling by powers of two and dropping digits."""
    wide = value.cast("float").cast("double")
    size, sign = F.abs(wide), F.when(wide < 0, -1).otherwise(1)

    def limb(k: int) -> Column:
        near = (size >= weight(k)) & (size < weight(k) * 2.0**DIGITS)
        digits = (size * (1 / weight(k)) if k < 5 else size / weight(k)).cast("long").bitwiseAND(F.lit(2**WIDTH - 1))
        return F.when(near, sign * digits).otherwise(0).cast("long")

    return [limb(k) for k in range(LIMBS)]


def limb_sums(value: Column, name: str) -> list[Column]:
    """Aggregates over the rows of a group, one a limb; null rows add nothing."""
    return [F.sum(F.coalesce(limb, F.lit(0))).alias(n) for limb, n in zip(limbs(value), limb_names(name))]


def total(name: str) -> Column:
    """The sum as a double. It is exact where 53 digits hold it, and else off by a few units of the last place, always the same way."""
    parts = [F.col(n) for n in limb_names(name)]
    spread = sum((F.abs(p).cast("double") * weight(k) for k, p in enumerate(parts[1:], 1)), F.abs(parts[0]).cast("double") * weight(0))
    lowest = F.lit(weight(LIMBS))
    for k in reversed(range(LIMBS)):
        lowest = F.when(parts[k] != 0, F.lit(weight(k))).otherwise(lowest)
    plain = sum((p.cast("double") * weight(k) for k, p in enumerate(parts[1:], 1)), parts[0].cast("double") * weight(0))
    return F.when(spread < lowest * 2.0**53, plain).otherwise(_carried(parts))


def _carried(parts: list[Column]) -> Column:
    """The limbs brought to one sign and below 2**WIDTH first, so that nothing cancels, then added from the smallest up."""
    negative = _digits(F.array(*parts))["carry"] < 0
    signed = F.when(negative, -1).otherwise(1)
    digits = _digits(F.transform(F.array(*parts), lambda p: signed * p))
    weights = F.array(*[F.lit(weight(k)) for k in range(LIMBS)])
    added = F.aggregate(F.zip_with(digits["digits"], weights, lambda d, w: d.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    return signed * (added + digits["carry"].cast("double") * weight(LIMBS))


def _digits(parts: Column) -> Column:
    def carry(state: Column, part: Column) -> Column:
        whole = part + state["carry"]
        return F.struct(
            F.shiftright(whole, WIDTH).alias("carry"), F.array_append(state["digits"], whole.bitwiseAND(F.lit(2**WIDTH - 1))).alias("digits"),
        )

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits")).cast(_STATE)
    return F.aggregate(parts, start, carry)
