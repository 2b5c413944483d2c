import math

import pytest

from rillstat.functions import text
from rillstat.functions.numbers import ieee_ratio
from rillstat.operators.aggregates import ratio_by
from rillstat.operators.telemetry import parse_lines, rejects
from rillstat.plans import jobs
from pyspark.sql import functions as F

GOLDEN = (
    "NYL00620_7A_1,NYL00620,20170704,NY/NNJ,13.15.0,Northeast,NYC East,n50-10MHz,5780,309136741.0,10344076929.0,"
    "8270454393.0,1930562519.04,1491367.394,2256932773.89,1583052.501,"
)
HEAD = "c,s,d,a,v,R,M,k,e,1,2,3"


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id INT, line STRING")


def parsed(spark, rest):
    return parse_lines(lines(spark, HEAD + rest)).collect()


def test_golden_line(spark):
    row = parse_lines(lines(spark, GOLDEN)).first()
    assert (row.region, row.market, row.num, row.den, row.counted) == (
        "Northeast", "NYC East", 1930562519.04, 1491367.394, True
    )
    ratio = ratio_by(parse_lines(lines(spark, GOLDEN)), ["market"], scale=1000.0).first()
    assert ratio.utput == 1930562519.04 / 1491367.394 / 1000


def test_null_and_empty_lines_are_neither_rows_nor_rejects(spark):
    df = lines(spark, None, "")
    assert parse_lines(df).count() == 0
    assert rejects(df).count() == 0


@pytest.mark.parametrize("rest", [",,", ",,,,", ",,,,,,"])
def test_rest_of_commas_adds_zeros(spark, rest):
    (row,) = parsed(spark, rest)
    assert (row.market, row.num, row.den, row.counted) == ("M", 0.0, 0.0, False)


@pytest.mark.parametrize(
    "rest",
    ["", ",", ",5", ",5,", ",5,,", ",,5", ",,,5", ",x,5", ",5,x", ",inf,1", ",nan,1", ",-INF,1", ",infinity,1", ",1 2,3"],
)
def test_bad_rests(spark, rest):
    assert parsed(spark, rest) == []
    assert rejects(lines(spark, HEAD + rest)).count() == 1


@pytest.mark.parametrize(
    "rest, num, den",
    [
        (",5,6", 5.0, 6.0),
        (",5,6,", 5.0, 6.0),
        (",5,6,7,8", 5.0, 6.0),
        (", 5 ,\t6", 5.0, 6.0),
        (",-.5,1e2", -0.5, 100.0),
        (",Infinity,1", math.inf, 1.0),
        (",-Infinity,1", -math.inf, 1.0),
        (",1e999,1", math.inf, 1.0),
        (",1d,2f", 1.0, 2.0),
    ],
)
def test_good_rests(spark, rest, num, den):
    (row,) = parsed(spark, rest)
    assert (row.num, row.den, row.counted) == (num, den, True)


def test_nan_is_a_number(spark):
    (row,) = parsed(spark, ",NaN,1")
    assert math.isnan(row.num)


def test_other_columns_stay_and_rejects_keep_the_line(spark):
    df = lines(spark, HEAD + ",1,2", "a,b")
    assert parse_lines(df).columns == ["id", "region", "market", "num", "den", "counted"]
    assert [tuple(r) for r in rejects(df).collect()] == [(1, "a,b")]


def test_fail_stops_the_job(spark):
    assert parse_lines(lines(spark, HEAD + ",1,2", ""), on_error="fail").count() == 1
    with pytest.raises(Exception, match="bad telemetry line: a,b"):
        parse_lines(lines(spark, "a,b"), on_error="fail").collect()
    with pytest.raises(ValueError):
        parse_lines(lines(spark), on_error="ignore")


def test_a_line_is_split_once(spark):
    plan = parse_lines(lines(spark, GOLDEN))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_ieee_ratio(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (math.nan, 0.0), (3.0, 2.0), (0.0, 2.0), (math.inf, 2.0), (1.0, math.nan)],
        "n DOUBLE, d DOUBLE",
    )
    values = [r[0] for r in rows.select(ieee_ratio("n", "d")).collect()]
    assert math.isnan(values[0]) and values[1] == math.inf and values[2] == -math.inf and math.isnan(values[3])
    assert values[4:7] == [1.5, 0.0, math.inf] and math.isnan(values[7])


def test_blank_lines_count_only_without_windows(spark):
    df = lines(spark, HEAD + ",,", HEAD + ",4,2").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = parse_lines(df)
    total = ratio_by(rows, ["market"]).first()
    window = ratio_by(rows, ["market"], every="1 second").first()
    assert (total["count"], total.utput) == (2, 2.0)
    assert (window["count"], window.utput, window.start_time) == (1, 2.0, 1704067200000)


def test_only_blank_lines_give_nan(spark):
    assert math.isnan(ratio_by(parse_lines(lines(spark, HEAD + ",,")), ["market"]).first().utput)


def test_windows_before_the_epoch_and_without_time(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP'1969-12-31 23:59:59.9', 1D, 1D, true), (NULL, 1D, 1D, true) t(ts, num, den, counted)"
    )
    assert [r.start_time for r in ratio_by(rows, [], every="1 hour").collect()] == [-3600000]


def test_result_texts(spark):
    df = lines(spark, HEAD + ",3000,2").withColumn("ts", F.lit("2024-01-01 00:00:00.7").cast("timestamp"))
    windowed = jobs.market_ratio_records(jobs.market_ratios(df)).first()
    assert (windowed.key, windowed.value) == (
        "M", '{"market":"M", "start_time":"1704067200000", "count":"1", "UTput":"1.5"}'
    )
    plain = jobs.date_market_records(jobs.date_market_ratios(df.withColumn("key", F.lit(None)))).first()
    assert (plain.key, plain.value) == ("Date:null_Region:R_Market:M", '{"count":"1", "UTput":"1500.0"}')
    infinite = spark.range(1).select(text.ratio_json(F.lit(1), F.lit(math.inf))).first()[0]
    assert infinite == '{"count":"1", "UTput":"Infinity"}'


def test_result_text_of_awkward_market_parses(spark):
    from rillstat.sources.results import parse_result_json

    market = 'a"b\\c:d,e'
    value = text.window_ratio_json(F.lit(market), F.lit(5), F.lit(2), F.lit(1.0e7))
    row = parse_result_json(spark.range(1).select(value.alias("value"))).first()
    assert tuple(row) == (market, 5, 2, 1.0e7)


def test_unwindowed_result_text_parses(spark):
    from rillstat.sources.results import parse_result_json

    value = text.ratio_json(F.lit(2), F.lit(float("nan")))
    row = parse_result_json(spark.range(1).select(value.alias("value"))).first()
    assert row.market is None and row.start_time is None and row["count"] == 2 and math.isnan(row.utput)


def test_messages(spark):
    from rillstat.sources.results import parse_message

    rows = spark.createDataFrame([("Oregon,1.25,1704067200000",), ("Oregon,-Infinity,1",), ("x",)], "value STRING")
    assert [tuple(r) for r in parse_message(rows).collect()] == [
        ("Oregon", 1.25, 1704067200000), ("Oregon", -math.inf, 1), ("x", None, None)
    ]


def test_levels(spark):
    rows = spark.createDataFrame([(1.4,), (1.5,), (math.nan,), (-math.inf,)], "utput DOUBLE")
    from rillstat.operators.selections import with_level

    assert [r.level for r in with_level(rows).collect()] == ["low", "ok", "ok", "low"]
