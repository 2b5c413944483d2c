"""Text forms of results: composite keys, JSON values, messages and console lines.

Plain ``concat`` stays inside generated code; ``format_string`` would call the
Java formatter per row and ``to_json`` would leave out the blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of the JSON values, all of them quoted.
RESULT_FIELDS = "market STRING, start_time STRING, count STRING, UTput STRING"


def _shown(value: Column) -> Column:
    """The value as text; a NULL prints ``null``."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def _json_string(value: Column) -> Column:
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(escaped, F.lit('"'), F.lit('\\"'))


def date_region_market_key(date: Column, region: Column, market: Column) -> Column:
    """``Date:<date>_Region:<region>_Market:<market>``; a NULL date prints ``null``."""
    return F.concat(
        F.lit("Date:"), F.coalesce(date.cast("string"), F.lit("null")),
        F.lit("_Region:"), region, F.lit("_Market:"), market,
    )


def ratio_json(count: Column, ratio: Column) -> Column:
    """``{"count":"n", "UTput":"v"}``."""
    return F.concat(
        F.lit('{"count":"'), count.cast("string"), F.lit('", "UTput":"'), ratio.cast("string"), F.lit('"}')
    )


def window_ratio_json(market: Column, start: Column, count: Column, ratio: Column) -> Column:
    """``{"market":"m", "start_time":"ms", "count":"n", "UTput":"v"}``.

    Quotes and backslashes in the market are escaped, so that the text parses.
    """
    return F.concat(
        F.lit('{"market":"'), _json_string(market), F.lit('", "start_time":"'), start.cast("string"),
        F.lit('", "count":"'), count.cast("string"), F.lit('", "UTput":"'), ratio.cast("string"), F.lit('"}'),
    )


def message(series: Column, value: Column, start: Column) -> Column:
    """``series,value,start``, one chart point; a NULL prints ``null``."""
    return F.concat(_shown(series), F.lit(","), _shown(value), F.lit(","), _shown(start))


def window_key(key: Column, start: Column) -> Column:
    """``key@start``, the printed form of a windowed key; a NULL prints ``null``."""
    return F.concat(_shown(key), F.lit("@"), _shown(start))


def console_line(key: Column, value: Column) -> Column:
    """``key=value``; a NULL prints ``null``."""
    return F.concat(_shown(key), F.lit("="), _shown(value))


def level(value: Column, threshold: float = 1.5) -> Column:
    """``low`` below the threshold, else ``ok``; NaN is not below it."""
    return F.when(value < F.lit(float(threshold)), F.lit("low")).otherwise(F.lit("ok"))
