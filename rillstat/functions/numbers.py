"""Number parsing, and division with IEEE results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Non-finite values are numbers in this spelling only, or as the overflow of
#: digits. Spark's cast would also take ``inf`` and ``nan``.
NON_FINITE_TEXT = r"^[\x00-\x20]*[+-]?(NaN|Infinity)[\x00-\x20]*$|[0-9]"


def strict_double(text: str, value: str) -> str:
    """SQL for ``value``, the ``try_cast`` of ``text``, or NULL if the spelling is not allowed."""
    non_finite = f"(isnan({value}) OR abs({value}) = double('Infinity'))"
    return f"CASE WHEN {non_finite} AND NOT {text} RLIKE r'{NON_FINITE_TEXT}' THEN NULL ELSE {value} END"


def ieee_ratio(numerator: str, denominator: str, scale: float = 1.0) -> Column:
    """``numerator / denominator / scale`` with 0/0 = NaN and x/0 = signed infinity.

    ANSI mode raises on a zero divisor, so the division only runs for the others.
    """
    n, d = numerator, denominator
    ratio = f"""CASE WHEN {d} <> 0 THEN {n} / {d}
        WHEN {n} IS NULL OR {d} IS NULL THEN NULL
        WHEN {n} = 0 OR isnan({n}) THEN double('NaN')
        WHEN {n} < 0 THEN double('-Infinity') ELSE double('Infinity') END"""
    return F.expr(ratio if scale == 1.0 else f"({ratio}) / double({scale!r})")
