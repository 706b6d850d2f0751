"""Plans hold at scale: pruned scans, pushed filters, no single-task windows over rows, early row limits."""

import re

import pytest
from pyspark.sql import functions as F

from framekit.operators import cleaning as C
from framekit.operators import inspection as I
from framekit.operators import selection as S
from framekit.operators import stats as X
from framekit.plans import catalogue as Q
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(I.describe(Q.lineitem(spark, SMALL), Q.MEASURES)))
    assert read and all({c.split(":")[0] for c in r.split(",")} <= set(Q.MEASURES) for r in read)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(X.scalar(Q.orders(spark, SMALL), "o_totalprice", "sum")))
    assert read == ["o_totalprice:double"]


def test_filters_reach_the_scan(spark):
    text = plan(S.at(Q.nation(spark, SMALL), 7, "n_name", "n_nationkey"))
    assert "EqualTo(n_nationkey,7)" in text
    assert "GreaterThan(o_totalprice,200000" in plan(S.iloc(Q.orders(spark, SMALL), "o_totalprice > 200000", [0, 3]))


@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_fills_are_windowed_by_range(spark, method):
    text = plan(C.fillna(Q.holes(spark, SMALL), "x", method=method, order_by="event_id", target="v"))
    windows = [w for w in text.splitlines() if "Window" in w and "event_id" in w]
    assert windows and all("__bucket" in w for w in windows)


@pytest.mark.parametrize("name", ["clean_bfill", "clean_bfill_text", "clean_bfill_dt", "clean_group_bfill", "clean_group_bfill_text", "clean_group_bfill_dt", "clean_ffill"])
def test_fills_take_one_look_at_a_row(spark, name):
    # A frame from the current row on is worked out anew for each row: the square of a range's rows.
    text = plan(Q.QUERIES[name](spark, SMALL)).lower()
    assert "specifiedwindowframe(rowframe, unboundedpreceding$(), currentrow$())" in text and "unboundedfollowing" not in text


def test_first_rows_are_limited_before_the_shuffle(spark):
    text = plan(C.drop_duplicates(Q.orders(spark, SMALL), ["o_custkey"], "first", "o_orderkey"))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_group_statistics_are_added_up_before_the_shuffle(spark):
    text = plan(C.groupby_fillna(Q.gappy(spark, SMALL), "q", ["l_returnflag"], target="v"))
    assert "partial_avg" in text and "Window" not in text


def test_matrices_are_one_pass(spark):
    assert plan(X.corr(Q.lineitem(spark, SMALL), Q.MEASURES)).count("Scan parquet") + plan(X.corr(Q.lineitem(spark, SMALL), Q.MEASURES)).count("FileScan parquet") <= 2


def test_info_expands_nothing(spark):
    text = plan(I.info(Q.customer(spark, SMALL)))
    assert "Expand" not in text and "Union" in text


def test_modes_and_medians_of_groups_are_counted_first(spark):
    for method in ("mode", "median"):
        text = plan(C.groupby_fillna(Q.gappy(spark, SMALL), "q", ["l_returnflag"], method=method, target="v"))
        assert "partial_count" in text and "mode(" not in text and " median(" not in text and "Window" not in text


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if re.match("clean_group_fillna_(?!constant)|clean_compress_rare", n)])
def test_rows_of_few_groups_are_not_dealt_by_group(spark, name):
    # Tables that are large are never broadcast by their size.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(Q.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


def test_quantiles_are_taken_of_few_rows(spark):
    from framekit.functions import quantiles as K

    df = spark.range(200_000).selectExpr("cast((id * 7919) % 200000 as double) v")
    found = df.agg(K.quantiles(df, [F.col("v")], [0.5])[0].alias("q"))
    assert "CASE WHEN" in plan(found) and found.first()["q"] == [99_999.5]
    low, high = map(float, re.search(r">= ([\d.]+)\) AND .*?<= ([\d.]+)\)", plan(found)).groups())
    assert 0 < high - low < 1000


def test_files_without_line_ends_in_fields_are_split(spark, tmp_path):
    from framekit.sources.csv import survey

    one, two = tmp_path / "a.csv", tmp_path / "b.csv"
    one.write_text('a,b\n1,"x ""y"""\n')
    two.write_text('a,b\n1,"x\ny"\n')
    assert survey(spark, str(one)) == ("utf-8", False) and survey(spark, str(two)) == ("utf-8", True)
    late = tmp_path / "c.csv"
    late.write_bytes(b"a,b\n" + b"1,plain\n" * 40_000 + b"2,caf\xe9\n")
    assert survey(spark, str(late)) == ("iso-8859-1", False)
    late.write_bytes(b"a,b\n" + b"1,plain\n" * 40_000 + b"2,5 \x80\n")
    assert survey(spark, str(late)) == ("windows-1252", False)
