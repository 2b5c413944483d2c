"""The registered queries in SQL, for a check against another engine."""

from __future__ import annotations

from rillstat.plans.queries import CHART_MARKETS, MBIT_PLACES
from rillstat.sources import synthetic as syn

_TEL = """
tel AS (SELECT event_id, ts, CASE WHEN event_id % 97 = 0 THEN '' ELSE concat_ws(',',
  concat('CELL', CAST(user_id % 40 AS VARCHAR)), concat('SITE', CAST(user_id % 20 AS VARCHAR)), '20240101', 'XX/YY', '13.15.0',
  concat('R', CAST(user_id % 5 AS VARCHAR)), concat('M', CAST(user_id % 25 AS VARCHAR)), event_type, '5780', '1.0', '2.0', '3.0',
  CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), CAST(event_id % 7 AS VARCHAR), '4.0', '5.0', '') END AS line
  FROM events)"""

_TEL_BAD = _TEL + """,
tel_bad AS (SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN 'a,b'
  WHEN event_id % 17 = 0 THEN replace(line, ',3.0,', ',3.0,x') ELSE line END AS line FROM tel)"""


def _parsed(source: str) -> str:
    return f"""
{source}_all AS (SELECT event_id, ts, line, split_part(line, ',', 6) AS region, split_part(line, ',', 7) AS market,
  TRY_CAST(split_part(line, ',', 13) AS DOUBLE) AS num, TRY_CAST(split_part(line, ',', 14) AS DOUBLE) AS den
  FROM {source} WHERE length(line) > 0),
parsed AS (SELECT * FROM {source}_all WHERE num IS NOT NULL AND den IS NOT NULL)"""


def _ratios(interval: str) -> str:
    return f"""WITH {_TEL}, {_parsed('tel')},
ratios AS (SELECT market, epoch_ms(time_bucket(INTERVAL '{interval}', ts)) AS start_time,
  count(*) AS count, sum(num) / sum(den) / 1000 AS raw FROM parsed GROUP BY ALL),
points AS (SELECT market, start_time, count, round(raw, {MBIT_PLACES}) AS utput, raw FROM ratios)"""


_HOURLY = _ratios("1 hour") + " SELECT market, start_time, count, utput FROM points"

_FINAL = _ratios("1 hour") + """
SELECT market, start_time, count, utput FROM points
QUALIFY row_number() OVER (PARTITION BY market ORDER BY start_time DESC) > 2"""

_DATED = f"""WITH {_TEL}, {_parsed('tel')}, dated AS (SELECT concat('Date:',
  CASE WHEN event_id % 10 = 0 THEN 'null' ELSE strftime(ts, '%Y%m%d') END, '_Region:', region, '_Market:', market) AS series,
  num, den FROM parsed)"""

_DATED_RATIO = _DATED + """
SELECT series, count(*) AS count, round(sum(num) / sum(den), 8) AS utput FROM dated GROUP BY series"""

def _exact(column: str, over: str = "") -> str:
    """The exact sum of doubles as a double: whole numbers of 2**-70 are added, and rounded once."""
    total = f"(sum((pow(2, 70) * {column})::HUGEINT){over})"
    unit = "9007199254740992"
    return f"((({total} // {unit}::HUGEINT)::DOUBLE * {unit}::DOUBLE + ({total} % {unit}::HUGEINT)::DOUBLE) / pow(2, 70))"


_EXACT_HOURLY = f"""WITH {_TEL}, {_parsed('tel')},
sums AS (SELECT market, epoch_ms(time_bucket(INTERVAL '1 hour', ts)) AS start_time, count(*) AS count,
  {_exact('num')} AS numerator, {_exact('den')} AS denominator FROM parsed GROUP BY ALL)
SELECT *, numerator / denominator / 1000 AS utput FROM sums"""

_EXACT_DATED = _DATED + f""",
sums AS (SELECT series, count(*) AS count, {_exact('num')} AS numerator, {_exact('den')} AS denominator FROM dated GROUP BY series)
SELECT *, numerator / denominator AS utput FROM sums"""

_UP_TO = " OVER (PARTITION BY series ORDER BY event_id)"

_CHANGELOG = _DATED.replace("num, den FROM parsed", "num, den, event_id FROM parsed") + f""",
sums AS (SELECT series, event_id, count(*){_UP_TO} AS count, {_exact('num', _UP_TO)} AS numerator, {_exact('den', _UP_TO)} AS denominator FROM dated)
SELECT *, numerator / denominator AS utput FROM sums"""

#: The starts that fall out of the two latest so far, and the last value of each up to then.
_PUBLICATIONS = """WITH updates AS (SELECT concat('M', CAST(user_id % 25 AS VARCHAR)) AS market,
  epoch_ms(date_trunc('hour', ts)) AS start_time, event_id AS count, value AS utput,
  CASE WHEN event_id % 9 = 0 THEN 2 * event_id + 801 ELSE 2 * event_id END AS seq FROM events),
held AS (SELECT *, list_slice(list_reverse_sort(list_distinct(list(start_time)
  OVER (PARTITION BY market ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), 1, 2) AS before FROM updates),
fallen AS (SELECT market, seq, least(start_time, before[2]) AS start_time FROM held WHERE len(before) = 2 AND NOT list_contains(before, start_time))
SELECT f.market, f.start_time, arg_max(u.count, u.seq) AS count, arg_max(u.utput, u.seq) AS utput, f.seq
FROM fallen f JOIN updates u ON u.market = f.market AND u.start_time = f.start_time AND u.seq <= f.seq GROUP BY f.market, f.start_time, f.seq"""

_VIEWS = """views AS (SELECT concat('u', CAST(user_id AS VARCHAR)) AS "user",
  concat('page', CAST(user_id % 20 AS VARCHAR), '.html') AS page, event_type AS industry,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'HOME' ELSE 'LONG_ARTICLE' END AS flags, ts FROM events)"""

def _counts(interval: str) -> str:
    return f"""counts AS (SELECT page, industry, epoch_ms(time_bucket(INTERVAL '{interval}', ts)) AS start_time,
  count(*) AS count FROM views WHERE flags LIKE '%ARTICLE%' GROUP BY ALL)"""


_COUNTS = _counts("1 hour")


def _top(views: str, n: int, interval: str = "1 hour") -> str:
    return f"""WITH {views}, {_counts(interval)}, top AS (SELECT page, industry, start_time, count,
  row_number() OVER (PARTITION BY industry, start_time ORDER BY count DESC, page) AS rank FROM counts QUALIFY rank <= {n})"""


_TOP_ROWS = " SELECT page, industry, start_time, count, rank FROM top"

_FEED_COUNT = """SELECT concat('u', CAST(user_id AS VARCHAR)) AS "user", count(*) AS count
FROM events WHERE event_id % 3 <> 0 GROUP BY 1"""


def _draw(identity: str, seed: int, stream: int, sides: int) -> str:
    state = f"(({identity}) % {syn._MODULUS} + {(seed * 1009 + stream * 7919) % syn._MODULUS})"
    for _ in range(3):
        state = f"(({state} * {syn._MULTIPLIER} + 11) % {syn._MODULUS})"
    return f"({state} % {sides})"


def _choice(values: list[str], number: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({number} AS BIGINT) + 1)"


_SYNTHETIC_VIEWS = f"""views AS (SELECT {_choice(syn.PAGES, _draw('event_id', 1, 2, len(syn.PAGES)))} AS page,
  {_choice(syn.INDUSTRIES, _draw(f'event_id // {syn.MAX_VIEWS}', 1, 3, len(syn.INDUSTRIES)))} AS industry,
  'ARTICLE' AS flags, ts FROM events
  WHERE event_id % {syn.MAX_VIEWS} < {_draw(f'event_id // {syn.MAX_VIEWS}', 1, 1, syn.MAX_VIEWS + 1)})"""

_SYNTHETIC_FEED = f"""SELECT {_choice(syn.USERS, _draw('event_id', 1, 5, len(syn.USERS)))} AS "user", count(*) AS count
FROM events WHERE event_id % {syn.MAX_ITEMS} < {_draw(f'event_id // {syn.MAX_ITEMS}', 1, 4, syn.MAX_ITEMS + 1)}
GROUP BY 1"""

#: A row is late if the greatest time of its market in the batches before has passed the end of its hour by half a second.
_LATE_SIDE = f"""WITH {_TEL}, {_parsed('tel')},
timed AS (SELECT market, num, den, epoch_ms(ts) AS moment, epoch_ms(time_bucket(INTERVAL '1 hour', ts)) AS start_time,
  CASE WHEN event_id % 10 = 0 THEN 4 ELSE least(3, event_id * 4 // (SELECT count(*) FROM events)) END AS batch FROM parsed),
judged AS (SELECT *, coalesce(start_time + 3600500 <= max(moment) OVER (PARTITION BY market ORDER BY batch
  RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM timed),
sums AS (SELECT market, start_time, count(*) AS count, {_exact('num')} AS numerator, {_exact('den')} AS denominator
  FROM judged WHERE NOT late GROUP BY market, start_time),
put_aside AS (SELECT market, start_time, count(*) AS late FROM judged WHERE late GROUP BY market, start_time)
SELECT market, start_time, count, numerator, denominator, numerator / denominator / 1000 AS utput, coalesce(late, 0) AS late
FROM sums FULL JOIN put_aside USING (market, start_time)"""

_PARSED_COLUMNS = " SELECT event_id, region, market, num, den FROM parsed"

ORACLES = {
    "telemetry_parse": f"WITH {_TEL}, {_parsed('tel')} {_PARSED_COLUMNS}",
    "telemetry_parse_faulty": f"WITH {_TEL_BAD}, {_parsed('tel_bad')} {_PARSED_COLUMNS}",
    "telemetry_rejects": f"""WITH {_TEL_BAD}, {_parsed('tel_bad')}
SELECT event_id, line FROM tel_bad_all WHERE num IS NULL OR den IS NULL""",
    "line_files": f"WITH {_TEL}, {_parsed('tel')} SELECT region, market, num, den FROM parsed",
    "ratio_by_date_region_market": _DATED + """
SELECT series, count(*) AS count, round(sum(num), 2) AS numerator, round(sum(den), 2) AS denominator,
  round(sum(num) / sum(den), 8) AS utput FROM dated GROUP BY series""",
    "ratio_by_market_1s": _ratios("1 second") + " SELECT market, start_time, count, utput FROM points",
    "ratio_by_market_1h": _HOURLY,
    "ratio_by_market_1h_exact": _EXACT_HOURLY,
    "ratio_by_date_region_market_exact": _EXACT_DATED,
    "ratio_changelog": _CHANGELOG,
    "publication_log": _PUBLICATIONS,
    "ratio_json_roundtrip": _HOURLY,
    "ratio_json_roundtrip_unwindowed": _DATED_RATIO,
    "final_windows_lag2": _FINAL,
    "latest_update_per_window": """SELECT concat('M', CAST(user_id % 25 AS VARCHAR)) AS market,
  epoch_ms(date_trunc('hour', ts)) AS start_time, arg_max(value, event_id) AS utput FROM events GROUP BY 1, 2""",
    "last_20_points": _ratios("1 hour") + """
SELECT market, start_time, count, utput FROM points
QUALIFY row_number() OVER (PARTITION BY market ORDER BY start_time DESC) <= 20""",
    "low_ratio_points": _ratios("1 hour") + f"""
SELECT market, start_time, count, utput, CASE WHEN raw < 0.03 THEN 'low' ELSE 'ok' END AS level
FROM points WHERE market IN ({', '.join(repr(m) for m in CHART_MARKETS)})""",
    "watched_series": _HOURLY + """
WHERE market IN (SELECT concat('M', CAST(user_id % 25 AS VARCHAR)) FROM events WHERE value > 400)""",
    "message_roundtrip": _ratios("1 hour") + " SELECT market, start_time, utput FROM points",
    "feed_count_by_user": _FEED_COUNT,
    "article_views": f"""WITH {_VIEWS}
SELECT 'user' AS "user", page, industry, ts FROM views WHERE flags LIKE '%ARTICLE%'""",
    "article_counts_1h": f"WITH {_VIEWS}, {_COUNTS} SELECT page, industry, start_time, count FROM counts",
    "top_articles": _top(_VIEWS, 100) + _TOP_ROWS,
    "top_3_articles": _top(_VIEWS, 3) + _TOP_ROWS,
    "top_articles_text": _top(_VIEWS, 100) + """
SELECT concat(industry, '@', CAST(start_time AS VARCHAR)) AS key,
  string_agg(page, chr(10) ORDER BY rank) || chr(10) AS value FROM top GROUP BY industry, start_time""",
    "console_lines": f"""WITH counts AS ({_FEED_COUNT})
SELECT concat("user", '=', CAST(count AS VARCHAR)) AS line FROM counts""",
    "synthetic_views": _top(_SYNTHETIC_VIEWS, 100) + _TOP_ROWS,
    "synthetic_feed": _SYNTHETIC_FEED,
    "stream_feed_count": _FEED_COUNT,
    "stream_date_region_market": _DATED_RATIO,
    "stream_latest_by_arrival": _DATED_RATIO,
    "stream_ratio_1h": _HOURLY,
    "stream_ratio_1s": _ratios("1 second") + " SELECT market, start_time, count, utput FROM points",
    "stream_late_rows": _HOURLY,
    "stream_messages": _ratios("1 hour") + """
SELECT market, start_time, utput FROM points QUALIFY row_number() OVER (PARTITION BY market ORDER BY start_time DESC) > 2""",
    "stream_top_articles_updates_1d": _top(_VIEWS, 100, "1 day") + _TOP_ROWS,
    "stream_console_lines": f"""WITH {_VIEWS} SELECT concat("user", '=', page) AS line FROM views""",
    "stream_lines_tagged": f"""WITH {_TEL} SELECT concat('T', event_id % 3) AS key, count(*) AS count FROM tel WHERE line <> '' GROUP BY 1""",
    "stream_paced_lines": f"""WITH {_TEL},
lanes AS (SELECT concat('T', event_id % 3) AS key, count(*) AS n FROM tel WHERE line <> '' GROUP BY 1),
pace AS (SELECT (max(n) + 3) // 4 AS k FROM lanes),
ticks AS (SELECT key, tick, tick * k AS first, least(n, (tick + 1) * k) - 1 AS last FROM lanes, pace, range(4) AS t(tick) WHERE tick * k < n)
SELECT key, tick, last - first + 1 AS count, last - first + 1 AS numbers, first, last FROM ticks""",
    "stream_fresh_run": _FEED_COUNT,
    "stream_count_retractions": f"WITH {_VIEWS}, {_COUNTS} SELECT page, industry, start_time, count FROM counts",
    "stream_industry_totals": f"""WITH {_VIEWS}, {_COUNTS}
SELECT industry, start_time, count(*) AS pages, sum(count)::BIGINT AS views FROM counts GROUP BY ALL""",
    "stream_last_20_points": _ratios("1 hour") + """
SELECT market, start_time, count, utput FROM points
QUALIFY row_number() OVER (PARTITION BY market ORDER BY start_time DESC) <= 20""",
    "stream_late_side": _LATE_SIDE,
    "stream_state_counts": _FEED_COUNT,
    "stream_counted_rejects": f"""WITH {_TEL_BAD}, {_parsed('tel_bad')}
SELECT (SELECT count(*) FROM tel_bad) AS lines, (SELECT count(*) FROM parsed) AS parsed,
  (SELECT count(*) FROM tel_bad_all WHERE num IS NULL OR den IS NULL) AS rejected,
  (SELECT count(*) FROM tel_bad WHERE line = '') AS empty, true AS adds_up""",
    "stream_rejects": f"""WITH {_TEL_BAD}, {_parsed('tel_bad')}
SELECT event_id, line FROM tel_bad_all WHERE num IS NULL OR den IS NULL""",
    "stream_doubled_records": _FEED_COUNT,
    "stream_ratio_updates_1h": _HOURLY,
    "stream_final_windows": _FINAL,
    "stream_top_articles": _top(_VIEWS, 100) + _TOP_ROWS,
    "stream_top_articles_updates": _top(_VIEWS, 100) + _TOP_ROWS,
}
