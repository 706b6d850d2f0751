"""Times without a zone stay what they are, whatever the session's zone and its changes of the clock."""

import datetime as dt
from statistics import median

import pytest

from framekit.functions import ordered
from framekit.operators import cleaning as C
from framekit.operators import stats as X
from framekit.operators.inspection import resample
from framekit.streaming import resample_stream

# The clock in New York leaves out 2:30 on 10 March and repeats 1:30 on 3 November.
TIMES = [dt.datetime(2024, 1, 14, 23), dt.datetime(2024, 1, 15, 0, 30), dt.datetime(2024, 3, 10, 1, 59, 59, 5), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2024, 11, 3, 2), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]


@pytest.fixture(params=["UTC", "America/New_York"])
def zoned(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def start(t, unit):
    if unit == "week":
        t -= dt.timedelta(days=t.weekday())
    cut = {"second": 6, "minute": 5, "hour": 4, "day": 3, "week": 3}.get(unit)
    if cut:
        return dt.datetime(*t.timetuple()[:cut])
    return dt.datetime(t.year, {"month": t.month, "quarter": (t.month - 1) // 3 * 3 + 1, "year": 1}[unit], 1)


def frame(spark):
    return spark.createDataFrame([(t, float(i), i) for i, t in enumerate(TIMES)], "t timestamp_ntz, v double, i int")


@pytest.mark.parametrize("unit", ["second", "minute", "hour", "day", "week", "month", "quarter", "year"])
def test_resample(zoned, unit):
    want = {}
    for i, t in enumerate(TIMES):
        want.setdefault(start(t, unit), []).append(float(i))
    got = {r[0]: r[1] for r in resample(frame(zoned), "t", unit, "SUM", "v").collect()}
    assert got == {k: sum(v) for k, v in want.items()}
    got = {r[0]: r[1] for r in resample(frame(zoned), "t", unit, "MEDIAN", "v").collect()}
    assert got == {k: median(v) for k, v in want.items()}
    if unit in ("second", "minute", "hour", "day", "week"):
        got = {r[0]: r[1] for r in resample_stream(frame(zoned), "t", unit, "SUM", "v").collect()}
        assert got == {k: sum(v) for k, v in want.items()}


def test_order_gaps_and_averages(zoned):
    df = frame(zoned)
    by_time = sorted(TIMES)
    assert [r["t"] for r in ordered.index(df, "t", "at").orderBy("at").collect()] == by_time
    gaps = {r["t"]: r["gap"] for r in X.datetime_diff(df, "t", "gap").collect()}
    assert all(abs(gaps[b] - (b - a).total_seconds()) < 1e-6 for a, b in zip(by_time, by_time[1:])) and gaps[by_time[0]] is None
    found = X.time_delta_stats(df, "t").first()
    assert abs(found["median_d"] - median((b - a).total_seconds() for a, b in zip(by_time, by_time[1:]))) < 1e-6
    middle = by_time[3] + (by_time[4] - by_time[3]) / 2
    assert abs((X.scalar(df, "t", "median").first()[0] - middle).total_seconds()) < 1e-5
    holed = zoned.createDataFrame([(t, i) for i, t in enumerate(TIMES)] + [(None, 99)], "t timestamp_ntz, i int")
    for method, want in (("min", by_time[0]), ("max", by_time[-1]), ("median", middle), ("mean", by_time[0] + sum((t - by_time[0] for t in TIMES), dt.timedelta()) / len(TIMES))):
        got = C.fillna(holed, "t", method=method, target="f").where("i = 99").first()["f"]
        assert abs((got - want).total_seconds()) < 1e-5, method


def test_half_microseconds_round_as_in_sql(spark):
    # Between 4 and 5 microseconds lies 4.5: the even number is 4, SQL's round gives 5 (and -5 before 1970).
    for first, want in ((4, 5), (-5, -5)):
        rows = spark.createDataFrame([(first,), (first + 1,)], "u bigint").selectExpr("timestamp_micros(u) t", "cast(timestamp_micros(u) as timestamp_ntz) n", "1 g")
        for column in ("t", "n"):
            for name in ("median", "mean"):
                assert X.scalar(rows, column, name).selectExpr("unix_micros(cast(value as timestamp))").first()[0] == want
        gappy = rows.select("g", "n").unionByName(spark.sql("select 1 g, cast(null as timestamp_ntz) n"))
        for name in ("median", "mean"):
            for filled in (C.fillna(gappy, "n", method=name, target="v"), C.groupby_fillna(gappy, "n", ["g"], method=name, target="v")):
                assert filled.where("n is null").selectExpr("unix_micros(cast(v as timestamp))").first()[0] == want
