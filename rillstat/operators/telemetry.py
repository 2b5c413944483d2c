"""Telemetry lines to typed rows.

A line holds comma-separated values: region at 5, market at 6 (from 0), and the
throughput numerator (kbit) and denominator (s) at 12 and 13.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.functions.numbers import strict_double

REGION, MARKET, NUMERATOR, DENOMINATOR = 5, 6, 12, 13

def non_empty(df: DataFrame, line: str = "line") -> DataFrame:
    """Drop empty lines and NULLs."""
    return df.where(F.col(line) != "")


def _examined(df: DataFrame, line: str, on_bad: str = "NULL", empty: bool = False) -> DataFrame:
    """The non-empty lines, or with ``empty`` all of them, with the columns of :func:`parse_lines`, NULL where a line is bad.

    Each step reads columns of the one before, so that a line is split once. The
    generator at the end keeps it so: a filter on what it puts out stays above it,
    where a filter on plain columns would be pushed below the split, with a split
    of its own for every column it names.
    """
    num, den, rest = (f"get(_parts, {i})" for i in (NUMERATOR, DENOMINATOR, DENOMINATOR + 1))
    # The limit leaves whatever follows the denominator in one piece.
    split = (df if empty else non_empty(df, line)).selectExpr("*", f"split(`{line}`, ',', {DENOMINATOR + 2}) AS _parts")
    values = split.selectExpr(
        "*",
        f"try_cast({num} AS DOUBLE) AS _num",
        f"try_cast({den} AS DOUBLE) AS _den",
        # All that is left after the twelfth comma may be commas, which stands for zeros.
        f"coalesce({num} = '' AND {den} = '' AND translate(coalesce({rest}, ''), ',', '') = '', false) AS _blank",
    )
    numbers = values.selectExpr(
        "* EXCEPT (_num, _den)",
        f"CASE WHEN _blank THEN 0D ELSE {strict_double(num, '_num')} END AS _num",
        f"CASE WHEN _blank THEN 0D ELSE {strict_double(den, '_den')} END AS _den",
    )
    record = f"""named_struct('region', get(_parts, {REGION}), 'market', get(_parts, {MARKET}),
        'num', _num, 'den', _den, 'counted', NOT _blank)"""
    records = f"CASE WHEN _num IS NOT NULL AND _den IS NOT NULL THEN array({record}) ELSE {on_bad} END"
    return numbers.selectExpr("* EXCEPT (_parts, _num, _den, _blank)", f"inline_outer({records})")


def examined(df: DataFrame, line: str = "line") -> DataFrame:
    """All rows of ``df`` with the columns of :func:`parse_lines` and ``kind``: ``parsed``, ``rejected`` or ``empty``.

    An empty line or NULL is ``empty``; what is not parsed has NULL in the parsed columns.
    """
    rows = _examined(df, line, empty=True)
    kind = F.when(F.coalesce(F.col(line), F.lit("")) == "", "empty").when(F.col("counted").isNull(), "rejected").otherwise("parsed")
    return rows.withColumn("kind", kind)


def parse_lines(df: DataFrame, line: str = "line", on_error: str = "drop") -> DataFrame:
    """The other columns of ``df`` plus ``region, market, num, den, counted``.

    ``counted`` is false for a line whose rest is commas alone: it adds zeros.
    A bad line (too few fields, or no number where one is due) is left out with
    ``on_error="drop"``, to be had from :func:`rejects`; ``"fail"`` stops the job.
    """
    if on_error not in ("drop", "fail"):
        raise ValueError(f"on_error must be 'drop' or 'fail', not {on_error!r}")
    if on_error == "fail":
        rows = _examined(df, line, f"raise_error(concat('bad telemetry line: ', `{line}`))")
    else:
        rows = _examined(df, line).where("counted IS NOT NULL")
    return rows.drop(line)


def rejects(df: DataFrame, line: str = "line") -> DataFrame:
    """The rows of ``df`` that :func:`parse_lines` leaves out, empty lines aside."""
    return _examined(df, line).where("counted IS NULL").select(*df.columns)
