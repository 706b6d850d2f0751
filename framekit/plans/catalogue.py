"""Every operator as a query over the shared tables, with its SQL twin.

The tables have no NULLs and no repeated rows, so queries that need them put
them in, alike on both sides. Floating sums depend on their order in the last
digits and are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions.ordered import fill, index, lag
from ..operators import arithmetic as A
from ..operators import cleaning as C
from ..operators import inspection as I
from ..operators import selection as S
from ..operators import stats as X
from ..plots import points
from ..streaming import resample_stream
from . import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


lineitem, orders, events, customer, part, nation, documents = map(_table, ("lineitem", "orders", "events", "customer", "part", "nation", "documents"))


def _add(name: str, of: Query, sql: str | None = None) -> None:
    QUERIES[name] = of
    if sql is not None:
        ORACLE_SQL[name] = sql


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Arithmetic

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_SQL = ", ".join(KEYS)


def _arith(name: str, of: Callable[[DataFrame], DataFrame], sql: str, digits: int = 6) -> None:
    _add(
        f"arith_{name}",
        lambda spark, sf_dir: of(lineitem(spark, sf_dir)).select(*KEYS, F.round("v", digits).alias("v")),
        f"SELECT {KEY_SQL}, round(CAST({sql} AS DOUBLE), {digits}) AS v FROM lineitem",
    )


for _op, _sql in {
    "add": "l_extendedprice + l_quantity",
    "subtract": "l_extendedprice - l_quantity",
    "sub": "l_extendedprice - l_quantity",
    "mul": "l_extendedprice * l_quantity",
    "div": "l_extendedprice / nullif(l_quantity, 0)",
    "mod": "CASE WHEN l_quantity <> 0 THEN mod(l_extendedprice, l_quantity) END",
    "atan2": "atan2(l_extendedprice, l_quantity)",
}.items():
    _arith(_op, lambda d, op=_op: A.binary(d, op, "l_extendedprice", "l_quantity", "v"), _sql, 9)
_arith("pow", lambda d: A.binary(d, "pow", "l_discount", 2, "v"), "power(l_discount, 2)")
_arith("add_scalar", lambda d: A.binary(d, "add", "l_extendedprice", "2.5", "v"), "l_extendedprice + 2.5")
for _op, _column, _sql in (
    ("abs", "l_discount", "abs(l_discount)"),
    ("negate", "l_quantity", "-l_quantity"),
    ("round", "l_discount", "round(l_discount)"),
    ("ceil", "l_extendedprice", "ceil(l_extendedprice)"),
    ("floor", "l_extendedprice", "floor(l_extendedprice)"),
    ("truncate", "l_extendedprice", "trunc(l_extendedprice)"),
    ("exp", "l_tax", "exp(l_tax)"),
    ("log", "l_discount", "CASE WHEN l_discount > 0 THEN ln(l_discount) END"),
    ("log10", "l_discount", "CASE WHEN l_discount > 0 THEN log10(l_discount) END"),
    ("sqrt", "l_extendedprice", "CASE WHEN l_extendedprice >= 0 THEN sqrt(l_extendedprice) END"),
    ("sin", "l_quantity", "sin(l_quantity)"),
    ("cos", "l_quantity", "cos(l_quantity)"),
    ("tan", "l_tax", "tan(l_tax)"),
    ("asin", "l_discount", "asin(l_discount)"),
    ("acos", "l_discount", "acos(l_discount)"),
    ("atan", "l_quantity", "atan(l_quantity)"),
):
    _arith(_op, lambda d, op=_op, c=_column: A.unary(d, op, c, "v"), _sql)
_arith("weighted_sum", lambda d: A.weighted_sum(d, "l_quantity", "l_tax", 3, 1, "v"), "(l_quantity * 3.0 + l_tax * 1.0) / 4.0")
_arith("percentage_change", lambda d: A.percentage_change(d, "l_quantity", "l_extendedprice", "v"), "(l_extendedprice - l_quantity) / nullif(abs(l_quantity), 0) * 100.0")
_arith("normalize_range", lambda d: A.normalize_range(d, "l_quantity", "v"), "(l_quantity - (SELECT min(l_quantity) FROM lineitem)) / nullif((SELECT max(l_quantity) FROM lineitem) - (SELECT min(l_quantity) FROM lineitem), 0)")

# Statistics

PRICE = "o_totalprice"


def _scalar(name: str, sql: str, digits: int | None = 4, table=orders, column: str = PRICE, of: str | None = None, frm: str = "orders") -> None:
    stat = of or name

    def run(spark, sf_dir):
        out = X.scalar(table(spark, sf_dir), column, stat)
        return out if digits is None else _rounded(out, "value", digits=digits)

    _add(f"stat_{name}", run, f"SELECT {sql if digits is None else f'round({sql}, {digits})'} AS value FROM {frm}")


_scalar("count", f"count({PRICE})", None)
_scalar("nunique", f"count(DISTINCT {PRICE})", None)
_scalar("sum", f"sum({PRICE})", 2)
_scalar("min", f"min({PRICE})", None)
_scalar("max", f"max({PRICE})", None)
_scalar("mean", f"avg({PRICE})")
_scalar("median", f"median({PRICE})")
_scalar("std", f"stddev_pop({PRICE})")
_scalar("var", f"var_pop({PRICE})", 0)
_scalar("sem", f"stddev_samp({PRICE}) / sqrt(count({PRICE}))")
_scalar("mad", f"avg(abs({PRICE} - (SELECT avg({PRICE}) FROM orders)))")
_scalar("iqr", f"quantile_cont({PRICE}, 0.75) - quantile_cont({PRICE}, 0.25)")
_scalar("range", f"max({PRICE}) - min({PRICE})")
_scalar("skew", f"skewness({PRICE})", 6)
_scalar("kurtosis", f"kurtosis({PRICE})", 6)
_scalar("entropy", "-sum(p * ln(p))", 8, column="o_orderpriority", frm="(SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM orders GROUP BY o_orderpriority)")
_scalar("coefficient_of_variation", f"stddev_pop({PRICE}) / avg({PRICE})", 8)
# The factors are near enough to 1 for the product over the whole table to be a number.
FACTOR = "1 + (l_tax - 0.04) / 1000"
_scalar("product", f"exp(sum(ln({FACTOR})))", 6, lambda s, d: lineitem(s, d).select(F.expr(FACTOR).cast("double").alias("f")), "f", frm="lineitem")
_scalar("dt_mean", "to_timestamp(round(avg(epoch(o_orderdate))))::TIMESTAMP", None, lambda s, d: orders(s, d), "o_orderdate", "mean")
QUERIES["stat_dt_mean"] = lambda s, d: X.scalar(orders(s, d), "o_orderdate", "mean").select(F.to_timestamp_ntz(F.from_unixtime(F.round(F.unix_micros(F.col("value").cast("timestamp")) / 1e6).cast("bigint"))).alias("value"))
ORACLE_SQL["stat_dt_mean"] = "SELECT make_timestamp(CAST(round(avg(epoch(o_orderdate))) AS BIGINT) * 1000000) AS value FROM orders"
_add("stat_dt_median", lambda s, d: X.scalar(events(s, d), "ts", "median"), "SELECT make_timestamp(CAST(round(median(epoch_us(ts))) AS BIGINT)) AS value FROM events")
_add("stat_dt_min", lambda s, d: X.scalar(events(s, d), "ts", "min"), "SELECT min(ts) AS value FROM events")
_add("stat_mode", lambda s, d: X.mode(orders(s, d), "o_orderpriority").select("value"), "SELECT o_orderpriority AS value FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
_add("stat_mode_topn", lambda s, d: X.mode(lineitem(s, d), "l_quantity", 3), "SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
_add("stat_value_counts", lambda s, d: X.value_counts(lineitem(s, d), "l_returnflag", 10), "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("stat_unique", lambda s, d: X.unique(orders(s, d), "o_orderpriority"), "SELECT DISTINCT o_orderpriority AS value FROM orders ORDER BY 1")
_add("stat_proportions", lambda s, d: _rounded(X.proportions(orders(s, d), "o_orderpriority"), "share", digits=8), "SELECT o_orderpriority AS value, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 8) AS share FROM orders GROUP BY 1")
_add("stat_quantile", lambda s, d: _rounded(X.quantile(orders(s, d), PRICE, [0.1, 0.5, 0.995]), "value"), f"SELECT q, round(value, 4) AS value FROM (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.995::DOUBLE]) AS q, unnest(quantile_cont({PRICE}, [0.1, 0.5, 0.995])) AS value FROM orders)")
_add(
    "stat_outliers_iqr",
    lambda s, d: _rounded(X.outliers_iqr(orders(s, d), PRICE), "q1", "q3", "iqr", "lower_bound", "upper_bound"),
    f"""WITH p AS (SELECT quantile_cont({PRICE}, 0.25) AS q1, quantile_cont({PRICE}, 0.75) AS q3 FROM orders)
SELECT '{PRICE}' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound FROM p""",
)
_add(
    "stat_outliers_zscore",
    lambda s, d: _rounded(X.outliers_zscore(orders(s, d), PRICE, 2.0), "mean", "std", "lower_bound", "upper_bound"),
    f"""WITH p AS (SELECT avg({PRICE}) AS m, stddev_pop({PRICE}) AS s FROM orders)
SELECT '{PRICE}' AS "column", round(m, 4) AS mean, round(s, 4) AS std, 2.0::DOUBLE AS threshold, round(m - 2 * s, 4) AS lower_bound, round(m + 2 * s, 4) AS upper_bound FROM p""",
)
_add("stat_autocorr", lambda s, d: _rounded(X.autocorr(events(s, d), "value", "event_id"), "value", digits=8), "SELECT round(corr(value, b), 8) AS value FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS b FROM events)")
_add("stat_autocorr_lag", lambda s, d: _rounded(X.autocorr(events(s, d), "value", "event_id", 7), "value", digits=8), "SELECT round(corr(value, b), 8) AS value FROM (SELECT value, lag(value, 7) OVER (ORDER BY event_id) AS b FROM events)")
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(of: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({of}({a}, {b}), 6) AS value FROM lineitem" for a in MEASURES for b in MEASURES)


_add("stat_corr", lambda s, d: _rounded(X.corr(lineitem(s, d), MEASURES), "value", digits=6), _pairs_sql("corr"))
_add("stat_cov", lambda s, d: _rounded(X.cov(lineitem(s, d), MEASURES), "value", digits=6), _pairs_sql("covar_samp"))
_add("stat_crosstab", lambda s, d: X.crosstab(lineitem(s, d), ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")

# Dates and times

_add("dt_diff", lambda s, d: _rounded(X.datetime_diff(events(s, d).select("event_id", "ts"), "ts", "gap"), "gap", digits=3), "SELECT event_id, ts, round(epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)), 3) AS gap FROM events")
_add(
    "dt_delta_stats",
    lambda s, d: _rounded(X.time_delta_stats(events(s, d), "ts"), "min_d", "max_d", "avg_d", "median_d", "std_d", digits=3),
    """SELECT count(g) AS cnt, round(min(g), 3) AS min_d, round(max(g), 3) AS max_d, round(avg(g), 3) AS avg_d, round(median(g), 3) AS median_d, round(stddev_pop(g), 3) AS std_d
FROM (SELECT epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) AS g FROM events)""",
)
for _unit, _n in (("second", 1), ("hour", 3600), ("day", 86400), ("week", 604800)):
    _add(f"dt_event_rate_{_unit}", lambda s, d, u=_unit: _rounded(X.event_rate(events(s, d), "ts", u), "value", digits=6), f"SELECT round(count(ts) / ((max(epoch(ts)) - min(epoch(ts))) / {_n}.0), 6) AS value FROM events")
for _unit in ("hour", "day", "month", "year", "dow", "quarter"):
    _add(f"dt_unit_{_unit}", lambda s, d, u=_unit: X.time_unit_counts(events(s, d), "ts", u), f"SELECT CAST(extract({_unit} FROM ts) AS BIGINT) AS unit, count(*) AS n FROM events GROUP BY 1")
_add("dt_weekend", lambda s, d: X.weekday_weekend_counts(orders(s, d), "o_orderdate"), "SELECT count(*) FILTER (dayofweek(o_orderdate) NOT IN (0, 6)) AS weekday, count(*) FILTER (dayofweek(o_orderdate) IN (0, 6)) AS weekend FROM orders")
_add(
    "dt_holiday",
    lambda s, d: X.holiday_counts(orders(s, d), "o_orderdate"),
    """SELECT CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 THEN 'New Year' WHEN month(o_orderdate) = 12 AND day(o_orderdate) = 25 THEN 'Christmas' ELSE 'non-holiday' END AS kind, count(*) AS n
FROM orders GROUP BY 1""",
)
for _rule, _unit in (("H", "hour"), ("D", "day"), ("W", "week"), ("M", "month"), ("Q", "quarter"), ("Y", "year")):
    _add(f"ins_resample_{_unit}", lambda s, d, r=_rule: _rounded(I.resample(events(s, d), "ts", r, "SUM", "value"), "value"), f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS value FROM events GROUP BY 1")
_add("ins_resample_right", lambda s, d: I.resample(orders(s, d), "o_orderdate", "month", label="right"), "SELECT (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS o_orderdate, count(*) AS value FROM orders GROUP BY 1")

# Cleaning

NULLED = "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END"


def gappy(spark, sf_dir) -> DataFrame:
    return lineitem(spark, sf_dir).select(*KEYS, "l_returnflag", "l_extendedprice", F.expr(NULLED).alias("q"), F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END").alias("s"), F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate END").alias("t"))


GAPPY = f"g AS (SELECT {KEY_SQL}, l_returnflag, l_extendedprice, {NULLED} AS q, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END AS s, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate END AS t FROM lineitem)"
MODE_SQL = "(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _fill(name: str, column: str, sql: str, digits: int | None = 6, **options) -> None:
    def run(spark, sf_dir):
        out = C.fillna(gappy(spark, sf_dir), column, target="v", **options).select(*KEYS, "v")
        return out if digits is None else _rounded(out, "v", digits=digits)

    value = f"coalesce({column}, {sql})"
    _add(f"clean_fillna_{name}", run, f"WITH {GAPPY} SELECT {KEY_SQL}, {value if digits is None else f'round({value}, {digits})'} AS v FROM g")


_fill("constant", "q", "7.0", value=7.0)
_fill("mean", "q", "(SELECT avg(q) FROM g)", method="mean")
_fill("median", "q", "(SELECT median(q) FROM g)", method="median")
_fill("mode", "q", MODE_SQL.format(c="q"), method="mode")
_fill("std", "q", "(SELECT stddev_pop(q) FROM g)", method="std")
_fill("var", "q", "(SELECT var_pop(q) FROM g)", method="variance")
_fill("min", "q", "(SELECT min(q) FROM g)", method="min")
_fill("max", "q", "(SELECT max(q) FROM g)", method="max")
_fill("text_constant", "s", "'none'", None, value="none")
_fill("text_mode", "s", MODE_SQL.format(c="s"), None, method="mode")
_fill("dt_constant", "t", "TIMESTAMP '2000-01-01'", None, value="2000-01-01", dtype="timestamp")
_fill("dt_min", "t", "(SELECT min(t) FROM g)", None, method="min")
_fill("dt_max", "t", "(SELECT max(t) FROM g)", None, method="max")
_fill("dt_mode", "t", MODE_SQL.format(c="t"), None, method="mode")
_fill("dt_mean", "t", "(SELECT make_timestamp(CAST(round(avg(epoch_us(t))) AS BIGINT)) FROM g)", None, method="mean")
_fill("dt_median", "t", "(SELECT make_timestamp(CAST(round(median(epoch_us(t))) AS BIGINT)) FROM g)", None, method="median")
for _name in ("dt_mean", "dt_median"):
    # Micro-second averages may round apart: compare whole seconds.
    _of = QUERIES[f"clean_fillna_{_name}"]
    QUERIES[f"clean_fillna_{_name}"] = lambda s, d, of=_of: of(s, d).withColumn("v", F.date_trunc("second", "v").cast("timestamp_ntz"))
    ORACLE_SQL[f"clean_fillna_{_name}"] = ORACLE_SQL[f"clean_fillna_{_name}"].replace(" AS v FROM g", ") AS v FROM g").replace("coalesce(t, (", "date_trunc('second', coalesce(t, (")
_add("clean_fillna_map", lambda s, d: C.fillna(gappy(s, d), "s", mapping={"F": "final", "O": "open"}, target="v").select(*KEYS, "v"), f"WITH {GAPPY} SELECT {KEY_SQL}, CASE s WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE s END AS v FROM g")


def _group(name: str, column: str, agg: str, digits: int | None = 6, **options) -> None:
    def run(spark, sf_dir):
        out = C.groupby_fillna(gappy(spark, sf_dir), column, ["l_returnflag"], target="v", **options).select(*KEYS, "v")
        return out if digits is None else _rounded(out, "v", digits=digits)

    value = f"coalesce({column}, a)"
    if agg == "mode":
        per = f"SELECT l_returnflag, arg_min({column}, row(-n, {column})) AS a FROM (SELECT l_returnflag, {column}, count(*) AS n FROM g WHERE {column} IS NOT NULL GROUP BY ALL) GROUP BY 1"
    else:
        per = f"SELECT l_returnflag, {agg} AS a FROM g GROUP BY 1"
    _add(f"clean_group_fillna_{name}", run, f"WITH {GAPPY}, p AS ({per}) SELECT {KEY_SQL}, {value if digits is None else f'round({value}, {digits})'} AS v FROM g JOIN p USING (l_returnflag)")


_group("mean", "q", "avg(q)", method="mean")
_group("median", "q", "median(q)", method="median")
_group("mode", "q", "mode", method="mode")
_group("std", "q", "stddev_pop(q)", method="std")
_group("var", "q", "var_pop(q)", method="var")
_group("min", "q", "min(q)", method="min")
_group("max", "q", "max(q)", method="max")
_group("text_mode", "s", "mode", None, method="mode")
_group("dt_min", "t", "min(t)", None, method="min")
_group("dt_max", "t", "max(t)", None, method="max")
_group("dt_mode", "t", "mode", None, method="mode")
for _mode, _sql in (("mean", "avg"), ("median", "median")):
    # Micro-second averages may round apart: whole seconds are compared.
    _add(
        f"clean_group_fillna_dt_{_mode}",
        lambda s, d, m=_mode: C.groupby_fillna(gappy(s, d), "t", ["l_returnflag"], method=m, target="v").select(*KEYS, F.date_trunc("second", "v").cast("timestamp_ntz").alias("v")),
        f"WITH {GAPPY}, p AS (SELECT l_returnflag, make_timestamp(CAST(round({_sql}(epoch_us(t))) AS BIGINT)) AS a FROM g GROUP BY 1) SELECT {KEY_SQL}, date_trunc('second', coalesce(t, a)) AS v FROM g JOIN p USING (l_returnflag)",
    )
_add("clean_group_fillna_constant", lambda s, d: C.groupby_fillna(gappy(s, d), "s", ["l_returnflag"], value="none", target="v").select(*KEYS, "v"), f"WITH {GAPPY} SELECT {KEY_SQL}, coalesce(s, 'none') AS v FROM g")

HOLES = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def holes(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "event_type", "ts", F.expr(HOLES).alias("x"), F.expr("CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_type END").alias("k"), F.expr("CASE WHEN event_id % 4 = 1 THEN NULL ELSE ts END").alias("u"))


HOLES_SQL = f"h AS (SELECT event_id, event_type, ts, {HOLES} AS x, CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_type END AS k, CASE WHEN event_id % 4 = 1 THEN NULL ELSE ts END AS u FROM events)"
for _mode, _fn, _frame in (("ffill", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("bfill", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")):
    _over = f"ORDER BY event_id ROWS BETWEEN {_frame}"
    _add(f"clean_{_mode}", lambda s, d, m=_mode: C.fillna(holes(s, d), "x", method=m, order_by="event_id", target="v").select("event_id", "v"), f"WITH {HOLES_SQL} SELECT event_id, {_fn}(x IGNORE NULLS) OVER ({_over}) AS v FROM h")
    _add(f"clean_{_mode}_text", lambda s, d, m=_mode: C.fillna(holes(s, d), "k", method=m, order_by="event_id", target="v").select("event_id", "v"), f"WITH {HOLES_SQL} SELECT event_id, {_fn}(k IGNORE NULLS) OVER ({_over}) AS v FROM h")
    _add(f"clean_group_{_mode}", lambda s, d, m=_mode: C.groupby_fillna(holes(s, d), "x", ["event_type"], method=m, order_by="event_id", target="v").select("event_id", "v"), f"WITH {HOLES_SQL} SELECT event_id, {_fn}(x IGNORE NULLS) OVER (PARTITION BY event_type {_over}) AS v FROM h")
    for _kind, _column in (("text", "k"), ("dt", "u")):
        _add(f"clean_group_{_mode}_{_kind}", lambda s, d, m=_mode, c=_column: C.groupby_fillna(holes(s, d), c, ["event_type"], method=m, order_by="event_id", target="v").select("event_id", "v"), f"WITH {HOLES_SQL} SELECT event_id, {_fn}({_column} IGNORE NULLS) OVER (PARTITION BY event_type {_over}) AS v FROM h")
    _add(f"clean_{_mode}_dt", lambda s, d, m=_mode: C.fillna(holes(s, d), "u", method=m, order_by="event_id", target="v").select("event_id", "v"), f"WITH {HOLES_SQL} SELECT event_id, {_fn}(u IGNORE NULLS) OVER ({_over}) AS v FROM h")
_add("clean_fillna_dt_now", lambda s, d: C.fillna(gappy(s, d), "t", method="now", target="v").select(*KEYS, F.when(F.col("t").isNotNull(), F.col("v")).alias("v"), (F.abs(F.unix_timestamp("v") - F.unix_timestamp(F.current_timestamp())) < 3600).alias("is_now")).select(*KEYS, "v", F.expr("v IS NULL AND is_now").alias("filled")), f"WITH {GAPPY} SELECT {KEY_SQL}, t AS v, t IS NULL AS filled FROM g")


def _lines(name: str, of: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(f"clean_{name}", lambda s, d: of(lineitem(s, d)).select(*KEYS, "v"), f"SELECT {KEY_SQL}, {sql} AS v FROM lineitem")


_lines("clip", lambda x: C.clip(x, "l_quantity", 10, 40, "v"), "CASE WHEN l_quantity BETWEEN 10 AND 40 THEN l_quantity END")
_lines("outliers", lambda x: C.drop_outliers(x, "l_extendedprice", 1.5, "v"), "CASE WHEN abs((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / nullif((SELECT stddev_pop(l_extendedprice) FROM lineitem), 0)) > 1.5 THEN NULL ELSE l_extendedprice END")
_lines("map", lambda x: C.map_values(x, "l_returnflag", {"R": "returned", "A": "accepted"}, "v"), "CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE l_returnflag END")
_lines("filter_valid", lambda x: C.filter_valid(x, "l_returnflag", ["R", "A"], "v"), "CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag END")
_lines("clip_dates", lambda x: C.clip_dates(x, "l_shipdate", "1995-01-01", "1996-12-31", "v"), "CASE WHEN l_shipdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN l_shipdate::DATE END")
_add("clean_compress_rare", lambda s, d: C.compress_rare(part(s, d), "p_brand", 80, target="v").select("p_partkey", "v"), "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) < 80 THEN 'other' ELSE p_brand END AS v FROM part")
_add("clean_to_numeric", lambda s, d: C.to_numeric(customer(s, d).select("c_custkey", F.col("c_name").alias("v")), "v", "bigint"), "SELECT c_custkey, CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS v FROM customer")
QUERIES["clean_to_numeric"] = lambda s, d: C.to_numeric(customer(s, d).select("c_custkey", F.regexp_replace("c_name", "#", " ").alias("v")), "v", "bigint")
ORACLE_SQL["clean_to_numeric"] = "SELECT c_custkey, CASE WHEN regexp_full_match(regexp_replace(c_name, '[^0-9.+-]', '', 'g'), '[+-]?[0-9]+') THEN CAST(regexp_replace(c_name, '[^0-9.+-]', '', 'g') AS BIGINT) END AS v FROM customer"
_add(
    "clean_fix_dates",
    lambda s, d: C.fix_dates(orders(s, d).select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN '0000-00-00' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END").alias("t")), "t", "v").select("o_orderkey", "v"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS v FROM orders",
)
_add("clean_dropna_any", lambda s, d: C.dropna(gappy(s, d)).select(*KEYS, "q"), f"WITH {GAPPY} SELECT {KEY_SQL}, q FROM g WHERE q IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL")
_add("clean_dropna_all", lambda s, d: C.dropna(gappy(s, d), how="all", columns=["q", "s"]).select(*KEYS), f"WITH {GAPPY} SELECT {KEY_SQL} FROM g WHERE q IS NOT NULL OR s IS NOT NULL")
_add("clean_dropna_thresh", lambda s, d: C.dropna(gappy(s, d), thresh=8).select(*KEYS), f"WITH {GAPPY} SELECT {KEY_SQL} FROM g WHERE 6 + (q IS NOT NULL)::INT + (s IS NOT NULL)::INT + (t IS NOT NULL)::INT >= 8")
_add("clean_dropna_cols", lambda s, d: C.dropna(gappy(s, d), axis=1), f"SELECT {KEY_SQL}, l_returnflag, l_extendedprice FROM lineitem")
_add("clean_drop_cols", lambda s, d: C.drop_columns(nation(s, d), ["n_name"]), "SELECT n_nationkey, n_regionkey FROM nation")
_add("clean_drop_rows", lambda s, d: C.drop_rows(orders(s, d), [0, 2, 5], "o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i NOT IN (0, 2, 5)")
_add("clean_isna", lambda s, d: C.isna(gappy(s, d).select("q", "s")), f"WITH {GAPPY} SELECT q IS NULL AS q, s IS NULL AS s FROM g")
_add("clean_notna", lambda s, d: C.notna(gappy(s, d).select("q", "s")), f"WITH {GAPPY} SELECT q IS NOT NULL AS q, s IS NOT NULL AS s FROM g")
for _keep, _dir in (("first", "ASC"), ("last", "DESC")):
    _add(f"clean_dedup_{_keep}", lambda s, d, k=_keep: C.drop_duplicates(orders(s, d), ["o_custkey"], k, "o_orderkey"), f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {_dir}) AS rn FROM orders) WHERE rn = 1")
_add("clean_dedup_none", lambda s, d: C.drop_duplicates(orders(s, d), ["o_custkey", "o_orderpriority"], False), "SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) WHERE n = 1")

# Selection

_add("sel_at", lambda s, d: S.at(nation(s, d), 7, "n_name", "n_nationkey"), "SELECT n_name AS value FROM nation WHERE n_nationkey = 7")
_add("sel_iat", lambda s, d: S.iat(orders(s, d), 25, PRICE, "o_orderkey"), f"SELECT {PRICE} AS value FROM orders ORDER BY o_orderkey OFFSET 25 LIMIT 1")
_add("sel_iloc_slice", lambda s, d: S.iloc(orders(s, d), "10:20", "0:3", "o_orderkey", False), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey OFFSET 10 LIMIT 10")
_add("sel_iloc_list", lambda s, d: S.iloc(orders(s, d), [3, 3, -1], None, "o_orderkey", False), "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT r.* EXCLUDE (i, n) FROM r JOIN (VALUES (3), (3), (-1)) w(p) ON i = CASE WHEN p < 0 THEN n + p ELSE p END")
_add("sel_iloc_where", lambda s, d: S.iloc(orders(s, d), "o_totalprice > 200000", [0, 3]), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
_add("sel_iloc_labels", lambda s, d: S.iloc(nation(s, d).withColumn("n_name", F.trim("n_name")), ["FRANCE", "NATION_3", "CHINA"], None, index_column="n_name"), "SELECT n_nationkey, trim(n_name) AS n_name, n_regionkey FROM nation WHERE trim(n_name) IN ('FRANCE', 'NATION_3', 'CHINA')")
_add("sel_get", lambda s, d: S.get(nation(s, d), ["n_name", "n_missing"], "none"), "SELECT n_name, 'none' AS n_missing FROM nation")
_add("sel_select_dtypes", lambda s, d: S.select_dtypes(customer(s, d), "numeric"), "SELECT c_acctbal, c_custkey, c_nationkey FROM customer")
_add("sel_select_dtypes_exclude", lambda s, d: S.select_dtypes(orders(s, d), exclude=["numeric", "categorical"]), "SELECT o_orderdate FROM orders")
LOOKUPS = ["1990-01-01 00:00:00", "1995-06-17 12:00:00", "1998-01-01 00:00:00"]
_add(
    "sel_asof",
    lambda s, d: S.asof(orders(s, d).select("o_orderkey", "o_orderdate", PRICE), LOOKUPS, "o_orderdate", tiebreak=["o_orderkey"]),
    f"""WITH w AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in LOOKUPS)}]) AS lookup)
SELECT lookup, o.o_orderkey, o.o_orderdate, o.{PRICE} FROM w LEFT JOIN LATERAL (SELECT * FROM orders WHERE o_orderdate <= lookup ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON TRUE""",
)

# Inspection

_add("ins_head", lambda s, d: I.head(orders(s, d), 12, order_by="o_orderkey"), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 12")
_add("ins_tail", lambda s, d: I.tail(orders(s, d), 12, ["o_orderkey", PRICE], "o_orderkey"), f"SELECT o_orderkey, {PRICE} FROM orders ORDER BY o_orderkey DESC LIMIT 12")
_add("ins_sample", lambda s, d: I.sample(orders(s, d), 20, None, 5, "o_orderkey"))
KINDS = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_add("ins_info", lambda s, d: I.info(customer(s, d)), " UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS type, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, round((count(*) - count({c}))::DOUBLE * 100.0 / count(*), 2) AS null_percentage, count(DISTINCT {c}) AS distinct_count FROM customer" for c, t in KINDS.items()))
DESCRIBED = {"count": "count({c})::DOUBLE", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)", "max": "max({c})"}
_add("ins_describe", lambda s, d: _rounded(I.describe(lineitem(s, d), MEASURES), *MEASURES), " UNION ALL ".join(f"SELECT '{k}' AS statistic, " + ", ".join(f"round({e.format(c=c)}, 4) AS {c}" for c in MEASURES) + " FROM lineitem" for k, e in DESCRIBED.items()))
_add("ins_null_analysis", lambda s, d: I.null_analysis(gappy(s, d), ["q", "s", "l_returnflag"]), f"WITH {GAPPY} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) > count({c}) AS contains_null, round((count(*) - count({c}))::DOUBLE * 100.0 / count(*), 2) AS percent_missing FROM g" for c in ("q", "s", "l_returnflag")))
_add(
    "ins_quality_missing",
    lambda s, d: _rounded(I.missing_values(gappy(s, d), ["q", "t"]), "missing_pct", "completeness"),
    f"WITH {GAPPY} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total, count({c}) AS non_null, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct, round(count({c}) * 100.0::DOUBLE / count(*), 4) AS completeness FROM g" for c in ("q", "t")),
)
_add("ins_quality_completeness", lambda s, d: _rounded(I.completeness(gappy(s, d), ["q", "s"]), "completeness"), f"WITH {GAPPY} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count({c}) * 100.0::DOUBLE / count(*), 4) AS completeness FROM g" for c in ("q", "s")))
_add(
    "ins_numeric_summary",
    lambda s, d: _rounded(I.numeric_summary(gappy(s, d), ["q", "l_extendedprice"]), "mean", "std", "min", "q25", "q50", "q75", "max"),
    f"WITH {GAPPY} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS nulls, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM g" for c in ("q", "l_extendedprice")),
)
_add("ins_astype", lambda s, d: I.astype(orders(s, d), dtype_map={"o_orderkey": "str", PRICE: "int64"}), f"SELECT o_orderkey::VARCHAR AS o_orderkey, CAST(round_even({PRICE}, 0) AS BIGINT) AS {PRICE} FROM orders")
_add("ins_map", lambda s, d: I.map_columns(orders(s, d), "x * 2", columns=[PRICE, "o_custkey"]), f"SELECT o_custkey * 2 AS o_custkey, {PRICE} * 2 AS {PRICE} FROM orders")
_add("ins_map_text", lambda s, d: I.map_columns(nation(s, d), "LOWER(x)", columns=["n_name"]), "SELECT lower(n_name) AS n_name FROM nation")
_add("ins_rename", lambda s, d: I.rename(nation(s, d), {"n_name": "name"}), "SELECT n_nationkey, n_name AS name, n_regionkey FROM nation")
_add("ins_insert", lambda s, d: I.insert(nation(s, d), "place", list(range(25)), "n_nationkey", False), "SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")


def _updates(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).where("o_orderkey % 3 = 0").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice + 1 END").alias(PRICE), F.lit("X").alias("o_orderstatus"))


_add(
    "ins_update",
    lambda s, d: I.update(orders(s, d), _updates(s, d), "o_orderkey"),
    f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN {PRICE} + 1 ELSE {PRICE} END AS {PRICE}, o_orderdate, o_orderpriority FROM orders",
)
_add("ins_shape", lambda s, d: s.createDataFrame([Dataset(None, "", orders(s, d)).shape()["shape"]], "rows bigint, columns bigint"), "SELECT count(*) AS rows, 6::BIGINT AS columns FROM orders")
_add("win_lag", lambda s, d: lag(events(s, d).select("event_id", "value"), "value", "event_id", "before"), "SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS before FROM events")
_add("win_index", lambda s, d: index(events(s, d).select("event_id", "ts"), "ts", "place"), "SELECT event_id, ts, row_number() OVER (ORDER BY ts) - 1 AS place FROM events")
_add("win_fill_two_keys", lambda s, d: fill(lineitem(s, d).select(*KEYS, F.expr(NULLED).alias("q")), "q", KEYS, "v").select(*KEYS, "v"), f"SELECT {KEY_SQL}, last_value({NULLED} IGNORE NULLS) OVER (ORDER BY {KEY_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM lineitem")


_add("plot_pie_points", lambda s, d: _rounded(points(orders(s, d), "pie", names="o_orderpriority", values=PRICE), PRICE, digits=2), f"SELECT o_orderpriority, round(sum({PRICE}), 2) AS {PRICE} FROM orders GROUP BY 1")
_add("plot_scatter_points", lambda s, d: points(customer(s, d), "scatter", x="c_nationkey", y="c_acctbal"), "SELECT c_nationkey, c_acctbal FROM customer")
for _rule, _unit in (("h", "hour"), ("d", "day"), ("w", "week")):
    _add(f"stream_resample_{_unit}", lambda s, d, r=_rule: _rounded(resample_stream(events(s, d), "ts", r, "SUM", "value"), "value"), f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS value FROM events GROUP BY 1")

_add("ins_resample_median", lambda s, d: _rounded(I.resample(events(s, d), "ts", "day", "MEDIAN", "value"), "value"), "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, round(median(value), 4) AS value FROM events GROUP BY 1")
sessions.register(_add, _table)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Describe lineitem's measures."""
    return I.describe(lineitem(spark, sf_dir), MEASURES)
