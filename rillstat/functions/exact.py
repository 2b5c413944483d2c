"""Sums of doubles that do not depend on the order of the rows.

A double is cut into digits of 30 bits, from 2**-120 up to 2**89. The digits are whole numbers, so
their sums are exact in any order, and combine before a shuffle like any sum. The total is put together from the
sums once per group and rounded once, to the nearest double. All steps are native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

#: Bits of a digit, digits, and the binary exponent of the lowest one.
BITS, DIGITS, LOWEST = 30, 7, -120

_STEP = float(2**BITS)


def _digit(value: Column, place: int) -> Column:
    """The digit at ``place``, between plus and minus half its size; digits add up to the value."""
    exponent = LOWEST + BITS * place
    whole = F.rint(value * F.lit(2.0**-exponent))
    above = F.rint(value * F.lit(2.0 ** -(exponent + BITS)))
    return (whole - above * F.lit(_STEP)).cast("bigint")


def _fits(value: Column) -> Column:
    """Whether the digits hold the whole value; zero, and what is finite, not huge and not tiny."""
    low = value * F.lit(2.0**-LOWEST)
    return (F.abs(value) < F.lit(2.0 ** (LOWEST + BITS * DIGITS - 1))) & (F.rint(low) == low)


def digit_sums(value: str, name: str, over: WindowSpec | None = None) -> list[Column]:
    """The aggregates, of groups or ``over`` a window, that :func:`exact_total` needs for the sum of column ``value``, to be called ``name``."""
    column = F.col(value)
    held = F.when(_fits(column), column)
    digits = [F.sum(_digit(held, place)) for place in range(DIGITS)]
    sums = [*digits, F.sum(F.when(~_fits(column), column)), F.count(column)]
    return [(s if over is None else s.over(over)).alias(n) for s, n in zip(sums, digit_names(name), strict=True)]


def digit_names(name: str) -> list[str]:
    """The columns of :func:`digit_sums`; sums of them over groups are those of the groups together."""
    return [*(f"_{name}_{place}" for place in range(DIGITS)), f"_{name}_rest", f"_{name}_rows"]


def _carried(digits: str) -> str:
    """SQL for the digits from 0 to 2**30 - 1 in ``o``, the lowest first, and what is above them in ``c``, which has the sign."""
    return f"""aggregate({digits}, named_struct('c', 0L, 'o', cast(array() AS ARRAY<BIGINT>)), (a, d) -> named_struct(
        'c', shiftright(a.c + d, {BITS}), 'o', array_append(a.o, (a.c + d) & {2**BITS - 1}L)))"""


def _rounded(carried: str) -> str:
    """SQL for the double next to what :func:`_carried` gives; not for negative numbers.

    Digits are taken from the top until there are 64 bits, more than a double has. One more bit says whether anything
    follows, so that the only rounding, that of the cast, goes the right way.
    """
    return f"""aggregate(reverse(array_append({carried}.o, {carried}.c)),
        named_struct('q', cast(0 AS DECIMAL(38,0)), 'e', {LOWEST - 1}, 's', false),
        (a, d) -> IF(a.q < 18446744073709551616BD,
            named_struct('q', cast(a.q * {2**BITS}BD + d AS DECIMAL(38,0)), 'e', a.e, 's', a.s),
            named_struct('q', a.q, 'e', a.e + {BITS}, 's', a.s OR d <> 0)),
        a -> cast(cast(a.q * 2BD + IF(a.s, 1BD, 0BD) AS DECIMAL(38,0)) AS DOUBLE) * pow(2D, a.e))"""


def exact_total(sums: DataFrame, name: str) -> DataFrame:
    """``sums`` with the double ``name`` in place of the columns of :func:`digit_sums`.

    It is the double next to the exact sum of the values. Values of 2**89 or more, with bits below 2**-120, or not finite are added
    as doubles are, in the order they come in. Nulls do not count; the sum of none is null.
    """
    digits = f"array({', '.join(f'coalesce(_{name}_{place}, 0L)' for place in range(DIGITS))})"
    total = f"""IF({_carried(digits)}.c < 0, -{_rounded(_carried(f'transform({digits}, d -> -d)'))}, {_rounded(_carried(digits))})"""
    whole = F.expr(f"IF(_{name}_rows > 0, {total} + coalesce(_{name}_rest, 0D), NULL)")
    return sums.withColumn(name, whole).drop(*digit_names(name))
