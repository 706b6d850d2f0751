"""Registry, lineage, replay, async twins, plots, dashboards, tools and streams."""

import asyncio
import datetime as dt

import pandas as pd
import pytest

from framekit import ConfigurationError, DataNotFoundError, Engine, OperationError
from framekit.agent import Agent, Step, profile, tools
from framekit.dashboard import Dashboard
from framekit.dataset import OPERATIONS, Dataset
from framekit.operators.inspection import resample
from framekit.sources.detect import detect
from framekit.sources.names import clean_columns
from framekit.streaming import resample_stream

FRAME = pd.DataFrame({"id": [1, 2, 3, 4], "a": [10, 20, 30, 40], "b": [1.5, 2.5, None, 4.5], "cat": list("xyxy")})


def test_registry(spark, tmp_path):
    with Engine(spark, str(tmp_path / "w")) as e:
        d = e.upload_df(FRAME, "one.csv")
        assert [t["filename"] for t in e.list_tables()] == ["one.csv"]
        with pytest.raises(DataNotFoundError):
            e.dataset()
        e.set_active(d.data_id)
        assert e.dataset() is d and e.get_active_table() == d.data_id
        with pytest.raises(DataNotFoundError):
            e.set_active("nope")
        with pytest.raises(ConfigurationError):
            e.dataset(d.data_id, FRAME)
    again = Engine(spark, str(tmp_path / "w"))
    back = again.dataset(d.data_id)
    assert back.to_pandas()["a"].tolist() == [10, 20, 30, 40]
    again.delete_table(d.data_id)
    assert again.list_tables() == []
    with pytest.raises(DataNotFoundError):
        again.delete_table(d.data_id)


def test_replay(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), deep_cache=True)
    d = e.upload_df(FRAME)
    cold = d.fillna("b").toPandas()
    warm = d.fillna("b").toPandas()
    pd.testing.assert_frame_equal(cold.sort_values("b", ignore_index=True), warm.sort_values("b", ignore_index=True))
    ops = e.list_operations(d.data_id)
    assert [o["opidx"] for o in ops] == [1] and e.retrieve_operation(d.data_id, 1) == f"{d.data_id}_1"
    d.describe()
    assert len(e.list_operations(d.data_id)) == 2
    e.clear_cache(d.data_id)
    assert e.list_operations(d.data_id) == []
    off = Engine(spark, str(tmp_path / "v"), deep_cache=False)
    f = off.upload_df(FRAME)
    f.fillna("b")
    assert off.list_operations(f.data_id)[0]["table_name"] is None


def test_external_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS sales")
    spark.createDataFrame([(1, "name_1", 2.0)], "id bigint, name string, value double").write.mode("overwrite").saveAsTable("sales.t1")
    e = Engine(spark, str(tmp_path / "w"))
    found = e.register_tables()
    assert found["sales"][0]["row_count"] == 1 and e.register_tables() == {}
    e.delete_table(found["sales"][0]["data_id"])
    assert spark.table("sales.t1").count() == 1
    spark.sql("DROP DATABASE sales CASCADE")


def test_twins(spark, tmp_path):
    d = Engine(spark, str(tmp_path / "w")).upload_df(FRAME)
    for name in OPERATIONS:
        assert hasattr(Dataset, f"a{name}"), name
    assert asyncio.run(d.amean("a")) == 25

    async def both():
        return await asyncio.gather(d.asum("a"), d.acount("b"))

    assert asyncio.run(both()) == [100, 3]


def test_plots_and_dashboard(spark, tmp_path):
    d = Engine(spark, str(tmp_path / "w")).upload_df(FRAME)
    for kind, options in (("bar", {"x": "cat", "y": "a"}), ("line", {"x": "id", "y": "a"}), ("scatter", {"x": "a", "y": "b"}), ("scatter_3d", {"x": "a", "y": "b", "z": "id"}), ("bar_polar", {"r": "a", "theta": "cat"})):
        assert getattr(d, kind)(**options) is not None
    pie = d.pie(names="cat", values="a")
    if isinstance(pie, dict):
        assert pie["data"] == {"cat": ["x", "y"], "a": [40, 60]}
    with pytest.raises(OperationError):
        d.bar(x="nope")
    with pytest.raises(OperationError):
        d.bar(data_frame=1, x="cat")
    page = Dashboard("T").add("n", 4).add("t", d.frame).add("f", pie)
    assert len(page.rows()) == 2 and "<h1>T</h1>" in page.render() and len(page.summarize()) == 3
    assert open(page.save(str(tmp_path / "d.html"))).read().startswith("<!doctype")


def test_agent(spark, tmp_path):
    d = Engine(spark, str(tmp_path / "w")).upload_df(FRAME)
    assert {"fillna", "mean", "iloc"} <= {t["name"] for t in tools()}
    assert profile(d)["columns"]["cat"]["values"]
    agent = Agent(d, lambda prompt, about, have: [Step("mean", {"column": "a"}), Step("sum", {"column": "a"}, [0])])
    assert agent.chat("?")["results"] == [25, 100]
    assert agent.dashboard("?").design()[1] == {"title": "2. sum", "kind": "metric", "row": 0, "column": 1}
    d.engine.enable_agent(agent.planner)
    d.engine.set_active(d.data_id)
    assert d.engine.chat("?")["results"] == [25, 100] and "2. sum" in d.engine.dashboard("?").render()
    with pytest.raises(ConfigurationError):
        Agent(d).chat("?")
    with pytest.raises(OperationError):
        agent.run([Step("mean", {"column": "a"}, [1]), Step("sum", {"column": "a"}, [0])])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h % 24, 5 * h % 60), float(h)) for h in range(40)]
    spark.createDataFrame(rows, "t timestamp_ntz, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    query = resample_stream(stream, "t", "h", "SUM", "v").writeStream.format("memory").queryName("resampled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    got = {r[0]: r[1] for r in spark.table("resampled").collect()}
    want = {r[0]: r[1] for r in resample(spark.createDataFrame(rows, "t timestamp_ntz, v double"), "t", "h", "SUM", "v").collect()}
    assert got == want
    with pytest.raises(OperationError):
        resample_stream(stream, "t", "month")


@pytest.mark.parametrize(
    "values,kind",
    [
        (["2024-01-01", "2024-02-03"], "date"),
        (["2024-01-01 10:00:00"], "timestamp_ntz"),
        (["2024-01-01T10:00:00+0200"], "timestamp"),
        (["yes", "no"], "boolean"),
        (["0", "1"], "boolean"),
        (["5", "-7"], "smallint"),
        (["70000"], "int"),
        (["5000000000"], "bigint"),
        (["1.5", "2"], "float"),
        (["1e5"], "string"),
        (["a", "b"], "string"),
        (["20240101"], "date"),
        (["nan", None, ""], "string"),
    ],
)
def test_detection(values, kind):
    assert detect(values) == kind


def test_names():
    assert clean_columns(["a b", "", "1x", "a b", '"q"']) == ["a_b", "column_1", "_1x", "a_b_1", "q"]


def test_replay_tells_versions_apart_across_sessions(spark, tmp_path):
    first = Engine(spark, str(tmp_path / "w"), deep_cache=True)
    d = first.upload_df(pd.DataFrame({"id": [1, 2, 3], "a": [1.0, None, 3.0]}))
    assert [r[0] for r in d.fillna("a", method="median").select("cleaned_a_median_filled").collect()] == [1.0, 2.0, 3.0]
    stored = first.list_operations(d.data_id)[0]["table_name"]
    other = Engine(spark, str(tmp_path / "w"), deep_cache=True)
    e = other.dataset(d.data_id)
    assert "cleaned_a_median_filled" in e.columns()
    e.update("id", spark.createDataFrame([(1, 100.0), (3, 300.0)], "id bigint, a double"))
    assert [r[0] for r in e.fillna("a", method="median").select("cleaned_a_median_filled").collect()] == [100.0, 200.0, 300.0]
    assert {c["table_name"] for c in other.list_operations(d.data_id)} > {stored}
    # On the same rows in a third session the result is found, and the column comes with it.
    again = Engine(spark, str(tmp_path / "v"), deep_cache=True)
    f = again.upload_df(pd.DataFrame({"id": [1, 2, 3], "a": [1.0, None, 3.0]}))
    f.describe()
    n = len(again.list_operations(f.data_id))
    third = Engine(spark, str(tmp_path / "v"), deep_cache=True)
    third.dataset(f.data_id).describe()
    assert len(third.list_operations(f.data_id)) == n


def test_a_hit_brings_its_column(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), deep_cache=True)
    d = e.upload_df(FRAME)
    d.fillna("b")
    row = next(r for r in e.registry if r["data_id"] == d.data_id)
    row["steps"], row["version"] = [], ""
    fresh = Dataset(e, d.data_id, spark.read.parquet(f"{e.warehouse}/{row['table_name']}"))
    calls = len(e.list_operations(d.data_id))
    assert fresh.fillna("b").count() == 4 and "cleaned_b_mean_filled" in fresh.columns() and len(e.list_operations(d.data_id)) == calls


def test_derived_columns_last(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    d = e.upload_df(FRAME)
    d.mul("a", 2, "twice")
    d.insert("place", [4, 3, 2, 1])
    d.rename({"cat": "kind"})
    for k in range(12):
        d.add("a", k, f"plus{k}")
    want = d.to_pandas()
    row = next(r for r in e.registry if r["data_id"] == d.data_id)
    assert row["table_name"] != d.data_id and 0 < len(row["steps"]) < 12
    back = Engine(spark, str(tmp_path / "w")).dataset(d.data_id)
    pd.testing.assert_frame_equal(back.to_pandas(), want)
    assert back.version == d.version
    e.close()
    pd.testing.assert_frame_equal(Engine(spark, str(tmp_path / "w")).dataset(d.data_id).to_pandas(), want)


def test_update_by_table_name(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS stock")
    spark.createDataFrame([(1, 77), (9, 1)], "id bigint, a bigint").write.mode("overwrite").saveAsTable("stock.newer")
    d = Engine(spark, str(tmp_path / "w")).upload_df(FRAME)
    d.update("id", "newer", schema="stock")
    assert d.to_pandas()["a"].tolist() == [77, 20, 30, 40]
    d.update("id", "stock.newer", overwrite=False)
    assert d.to_pandas()["a"].tolist() == [77, 20, 30, 40]
    spark.sql("DROP DATABASE stock CASCADE")


def test_sessions_keep_each_others_calls(spark, tmp_path):
    a = Engine(spark, str(tmp_path / "w"))
    d = a.upload_df(FRAME)
    b = Engine(spark, str(tmp_path / "w"))
    d.describe()
    b.dataset(d.data_id).info()
    assert len(Engine(spark, str(tmp_path / "w")).list_operations(d.data_id)) == 2


def test_tables_of_other_databases(spark, tmp_path):
    url, driver = "jdbc:derby:memory:framekit;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    e = Engine(spark, str(tmp_path / "w"))
    d = e.upload_df(FRAME.drop(columns="b"))
    e.write_table(d.data_id, url, "ITEMS", "overwrite", **driver)
    back = e.upload_table(url, "ITEMS", partition_column="id", lower=1, upper=5, partitions=2, **driver)
    assert sorted(map(tuple, back.frame.collect())) == sorted(map(tuple, d.frame.collect()))
    assert e.list_tables()[0]["filename"] == "ITEMS"


def test_wide_widgets():
    page = Dashboard("T").add("a", 1).add("b", 2, width=2).add("c", 3).add("d", 4)
    assert [[w.title for w in r] for r in page.rows()] == [["a"], ["b"], ["c", "d"]]
    assert [(x["row"], x["column"]) for x in page.design()] == [(0, 0), (1, 0), (2, 0), (2, 1)]
    with pytest.raises(OperationError):
        page.add("e", 5, width=3)
