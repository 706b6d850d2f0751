"""Queries over the dataset API: sessions, ingest, registry, lineage, replay, iteration, plots and pages, each with its SQL twin.

A query that only reports on a session clears its warehouse away; one whose rows
lie there leaves the folder to the end of the process.
"""

from __future__ import annotations

import asyncio
import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..agent import Agent, Step, profile, tools
from ..dashboard import Dashboard
from ..engine import Engine
from ..errors import DataNotFoundError, OperationError
from ..operators import inspection as I
from ..plots import points

Query = Callable[[SparkSession, str], DataFrame]


def _open(spark: SparkSession, **options: Any) -> Engine:
    """A session on a warehouse of its own, cleared away at the end of the process at the latest."""
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    engine = Engine(spark, f"{base}/framekit-query-{uuid.uuid4().hex}", **options)

    def clear() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended
            engine._delete("")

    atexit.register(clear)
    return engine


@contextlib.contextmanager
def _session(spark: SparkSession, **options: Any) -> Iterator[Engine]:
    engine = _open(spark, **options)
    try:
        yield engine
    finally:
        engine._delete("")


def _rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def register(add: Callable[..., None], table: Callable[[str], Callable[[SparkSession, str], DataFrame]]) -> None:
    """Add all queries by ``add(name, query, sql)``; ``table`` gives a reader of a shared table."""
    customer, nation, region, orders = map(table, ("customer", "nation", "region", "orders"))
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

    # Ingest

    def csv(spark: SparkSession, df: DataFrame, engine: Engine, **options: Any) -> str:
        path = f"{engine.warehouse}/in.csv"
        df.write.csv(path, header=True, escape='"', **options)
        return path

    def upload_csv(spark, sf_dir):
        e = _open(spark)
        return e.upload_csv(csv(spark, customer(spark, sf_dir).select(*columns), e)).frame

    add("ds_upload_csv", upload_csv, "SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey::INT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")

    def csv_types(spark, sf_dir):
        with _session(spark) as e:
            return _rows(spark, e.upload_csv(csv(spark, customer(spark, sf_dir).select(*columns), e)).dtypes().items(), "name string, type string")

    add("ds_csv_types", csv_types, "SELECT * FROM (VALUES ('c_custkey', 'int'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) t(name, type)")

    def csv_widened(spark, sf_dir):
        # Nothing in the first 5000 rows tells of the numbers over 32 bits, nor of the fractions.
        late = orders(spark, sf_dir).select("o_orderkey", F.expr("CASE WHEN o_orderkey % 997 = 0 THEN o_orderkey * 10000000000 ELSE o_custkey END").alias("big"), F.expr("CASE WHEN o_orderkey % 991 = 0 THEN CAST(o_orderkey + 0.5 AS STRING) ELSE CAST(o_custkey AS STRING) END").alias("fraction"))
        e = _open(spark)
        d = e.upload_csv(csv(spark, late, e), {"o_orderkey": "int64"})
        return d.frame.select("o_orderkey", F.col("big").cast("string").alias("big"), F.col("fraction").cast("double").alias("fraction"))

    add("ds_csv_widened", csv_widened, "SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 0 THEN o_orderkey::BIGINT * 10000000000 ELSE o_custkey END::VARCHAR AS big, CASE WHEN o_orderkey % 991 = 0 THEN o_orderkey + 0.5 ELSE o_custkey END::DOUBLE AS fraction FROM orders")

    def csv_text(spark, sf_dir):
        e = _open(spark)
        return e.upload_csv(csv(spark, customer(spark, sf_dir).select(*columns), e), dict.fromkeys(columns, "TEXT")).frame

    add("ds_csv_text", csv_text, "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer")
    for name, encoding, sign in (("utf8", "UTF-8", "→é"), ("latin", "ISO-8859-1", "é"), ("cp1252", "ISO-8859-1", "€é"), ("lines", "UTF-8", "a\n\"b\"")):

        def csv_encoded(spark, sf_dir, encoding=encoding, sign=sign.replace("€", "\x80")):
            # In windows-1252 the euro is the byte that iso-8859-1 has for a control character.
            e = _open(spark)
            return e.upload_csv(csv(spark, nation(spark, sf_dir).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.concat("n_name", F.lit(sign)).alias("n_name")), e, encoding=encoding), {"n_nationkey": "int64"}).frame

        add(f"ds_csv_{name}", csv_encoded, f"SELECT n_nationkey::BIGINT AS n_nationkey, n_name || '{sign}' AS n_name FROM nation")
    add("ds_upload_parquet", lambda s, d: _open(s).upload_parquet(f"{d}/orders.parquet").frame, "SELECT * FROM orders")
    add("ds_upload_df", lambda s, d: _open(s).upload_df(customer(s, d), "c.csv").frame, "SELECT * FROM customer")
    add("ds_upload_pandas", lambda s, d: _open(s).upload_df(region(s, d).select("r_name").toPandas()).frame, "SELECT r_name FROM region")

    def in_memory(spark, sf_dir):
        rows = [tuple(r) for r in nation(spark, sf_dir).select(F.col("n_nationkey").cast("bigint"), "n_name").collect()]
        return _open(spark).dataset(data=rows, columns=["key", "name"]).frame

    add("ds_dataset_data", in_memory, "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")

    def external(spark, sf_dir):
        name = f"framekit_query_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name}")
        try:
            nation(spark, sf_dir).write.saveAsTable(f"{name}.nation")
            with _session(spark) as e:
                found = e.register_tables()[name]
                rows = [(r["filename"], x["row_count"], e.dataset(r["data_id"]).shape()["shape"][1]) for r in e.list_tables() for x in found if x["data_id"] == r["data_id"]]
                again = len(e.register_tables().get(name, []))
                e.delete_table(found[0]["data_id"])
                return _rows(spark, [(*r, again, spark.table(f"{name}.nation").count()) for r in rows], "filename string, rows bigint, columns bigint, again bigint, left_rows bigint")
        finally:
            spark.sql(f"DROP DATABASE {name} CASCADE")

    add("ds_register_tables", external, "SELECT 'nation' AS filename, count(*) AS rows, 3::BIGINT AS columns, 0::BIGINT AS again, count(*) AS left_rows FROM nation")

    # Registry and lineage

    def registry(spark, sf_dir):
        with _session(spark) as e:
            a, b = e.upload_df(region(spark, sf_dir), "a.csv"), e.upload_df(nation(spark, sf_dir), "b.csv")
            e.set_active(b.data_id)
            listed = [t["filename"] for t in e.list_tables()]
            active = e.dataset(e.get_active_table()).shape()["shape"][0]
            e.delete_table(filename="b.csv")
            try:
                e.dataset()
                gone = False
            except DataNotFoundError:
                gone = True
            return _rows(spark, [(",".join(listed), active, len(e.list_tables()), gone, a.shape()["shape"][0])], "listed string, active_rows bigint, left_tables bigint, gone boolean, left_rows bigint")

    add("ds_registry", registry, "SELECT 'b.csv,a.csv' AS listed, (SELECT count(*) FROM nation) AS active_rows, 1::BIGINT AS left_tables, true AS gone, (SELECT count(*) FROM region) AS left_rows")

    def reopened(spark, sf_dir):
        first = _open(spark)
        d = first.upload_df(customer(spark, sf_dir), "c.csv")
        d.mul("c_acctbal", 2, "twice")
        d.rename({"c_name": "name"})
        first.close()
        return Engine(spark, first.warehouse).dataset(d.data_id).frame.select("c_custkey", "name", F.round("twice", 4).alias("twice"))

    add("ds_reopened", reopened, "SELECT c_custkey, c_name AS name, round(c_acctbal * 2, 4) AS twice FROM customer")

    def operations(spark, sf_dir):
        with _session(spark, deep_cache=True) as e:
            d = e.upload_df(nation(spark, sf_dir))
            d.describe()
            d.fillna("n_nationkey")
            d.outliers_zscore("n_nationkey")
            found = [(c["opidx"], c["method"], e.retrieve_operation(d.data_id, c["opidx"]) is not None) for c in e.list_operations(d.data_id)]
            e.clear_cache(d.data_id)
            return _rows(spark, [(*f, len(e.list_operations(d.data_id))) for f in found], "opidx int, method string, stored boolean, after_clear bigint")

    add("ds_operations", operations, "SELECT * FROM (VALUES (1, 'describe', true, 0::BIGINT), (2, 'fillna', true, 0::BIGINT), (3, 'outliers_zscore', false, 0::BIGINT)) t(opidx, method, stored, after_clear)")

    def replayed(spark, sf_dir):
        first = _open(spark, deep_cache=True)
        rows = customer(spark, sf_dir).select("c_custkey", F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END").alias("v"))
        d = first.upload_df(rows)
        d.fillna("v", method="max")
        other = Engine(spark, first.warehouse, deep_cache=True)
        e = other.dataset(d.data_id)
        e.update("c_custkey", rows.select("c_custkey", (F.col("v") + 1e6).alias("v")))
        e.fillna("v", method="max")
        return e.frame.select("c_custkey", F.round("cleaned_v_max_filled", 4).alias("v"))

    add("ds_replay", replayed, "SELECT c_custkey, round(CASE WHEN c_custkey % 4 = 0 THEN (SELECT max(c_acctbal) + 1000000 FROM customer WHERE c_custkey % 4 <> 0) ELSE c_acctbal + 1000000 END, 4) AS v FROM customer")

    # Datasets

    def of(name: str, make: Callable[[Any], Sequence[tuple]], schema: str, sql: str, source=nation) -> None:
        def run(spark, sf_dir):
            with _session(spark) as e:
                return _rows(spark, make(e.upload_df(source(spark, sf_dir).orderBy(F.col(source(spark, sf_dir).columns[0])))), schema)

        add(f"ds_{name}", run, sql)

    numbered = "(SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, * FROM nation)"
    of("columns", lambda d: [(c,) for c in d.columns()], "name string", "SELECT column_name AS name FROM (DESCRIBE nation)")
    of("dtypes", lambda d: d.dtypes().items(), "name string, type string", "SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) t(name, type)", customer)
    of("values", lambda d: [(i, str(v[1])) for i, v in enumerate(d.values()["values"])], "i int, name string", f"SELECT i::INT AS i, n_name AS name FROM {numbered}")
    of("items", lambda d: [(c, "|".join(map(str, v))) for c, v in d.items()], "name string, held string", "SELECT 'n_nationkey' AS name, string_agg(n_nationkey, '|' ORDER BY n_nationkey) AS held FROM nation UNION ALL SELECT 'n_name', string_agg(n_name, '|' ORDER BY n_nationkey) FROM nation UNION ALL SELECT 'n_regionkey', string_agg(n_regionkey, '|' ORDER BY n_nationkey) FROM nation")
    of("iterrows", lambda d: [(i, r["n_name"]) for i, r in d.iterrows()], "i int, name string", f"SELECT i::INT AS i, n_name AS name FROM {numbered}")
    of("itertuples", lambda d: [(t.Index, t.n_name) for t in d.itertuples()], "i int, name string", f"SELECT i::INT AS i, n_name AS name FROM {numbered}")
    of("chunks", lambda d: [(i, len(c)) for i, c in enumerate(d.full_table(chunk_size=7))], "chunk int, rows int", f"SELECT (i // 7)::INT AS chunk, count(*)::INT AS rows FROM {numbered} GROUP BY 1")
    of("full_table", lambda d: [(i, *r) for i, r in enumerate(d.full_table(["n_name"]).collect())], "i int, name string", f"SELECT i::INT AS i, n_name AS name FROM {numbered}")
    of("to_pandas", lambda d: [(i, n) for i, n in enumerate(d.to_pandas()["n_name"])], "i int, name string", f"SELECT i::INT AS i, n_name AS name FROM {numbered}")
    of("asynchronous", lambda d: [(float(asyncio.run(d.amean("n_nationkey"))),)], "value double", "SELECT avg(n_nationkey) AS value FROM nation")

    def indexed(d):
        refused = False
        try:
            d.set_index("n_regionkey")
        except OperationError:
            refused = True
        return [(d.set_index("n_nationkey"), refused, d.at(7, "n_name"))]

    of("set_index", indexed, "said string, refused boolean, name string", "SELECT 'Index set' AS said, (SELECT count(*) > count(DISTINCT n_regionkey) FROM nation) AS refused, n_name AS name FROM nation WHERE n_nationkey = 7")

    def profiled(d):
        found = d.statistical_profile_report(["c_acctbal", "c_nationkey"])
        return [(c, found["completeness"][c]["completeness"], found["numeric"][c]["count"], round(found["numeric"][c]["mean"], 4)) for c in found["numeric"]]

    of("profile_report", profiled, "name string, completeness double, n bigint, mean double", " UNION ALL ".join(f"SELECT '{c}' AS name, 100.0::DOUBLE AS completeness, count({c}) AS n, round(avg({c}), 4) AS mean FROM customer" for c in ("c_acctbal", "c_nationkey")), customer)

    def conflict(spark, sf_dir):
        with _session(spark) as e:
            d = e.upload_df(nation(spark, sf_dir))
            rows = []
            for label, key in (("same keys", F.col("n_nationkey")), ("other keys", F.col("n_nationkey") + 1000)):
                try:
                    d.update("n_nationkey", nation(spark, sf_dir).select(key.cast("int").alias("n_nationkey"), F.lit("x").alias("n_name")), errors="raise")
                    rows.append((label, False))
                except OperationError:
                    rows.append((label, True))
            return _rows(spark, rows, "label string, refused boolean")

    add("ds_update_raise", conflict, "SELECT 'same keys' AS label, count(*) > 0 AS refused FROM nation UNION ALL SELECT 'other keys', false")
    add(
        "ds_update_keep",
        lambda s, d: I.update(customer(s, d).withColumn("c_acctbal", F.expr("CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END")), customer(s, d).select("c_custkey", F.lit(1.5).alias("c_acctbal")), "c_custkey", overwrite=False),
        "SELECT * REPLACE (CASE WHEN c_custkey % 2 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal) FROM customer",
    )

    def sampled(spark, sf_dir):
        some, again = (I.sample(orders(spark, sf_dir), 20, None, 5, "o_orderkey").select(F.col("o_orderkey").alias("k")) for _ in (0, 1))
        known = some.join(orders(spark, sf_dir), F.col("k") == F.col("o_orderkey")).agg(F.count_distinct("k").alias("known"))
        return known.crossJoin(some.intersect(again).agg(F.count(F.lit(1)).alias("same")))

    add("ds_sample", sampled, "SELECT least(20, count(*)) AS known, least(20, count(*)) AS same FROM orders")

    # Plots, pages and agents

    for kind, source, options, sql in (
        ("bar", nation, {"x": "n_name", "y": "n_regionkey"}, "SELECT n_name, n_regionkey FROM nation"),
        ("bar_polar", nation, {"r": "n_regionkey", "theta": "n_name"}, "SELECT n_regionkey, n_name FROM nation"),
        ("line", orders, {"x": "o_orderdate", "y": "o_totalprice", "color": "o_orderstatus"}, "SELECT o_orderdate, o_totalprice, o_orderstatus FROM orders"),
        ("scatter_3d", customer, {"x": "c_custkey", "y": "c_nationkey", "z": "c_acctbal"}, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"),
    ):
        add(f"plot_{kind}_points", lambda s, d, k=kind, t=source, o=options: points(t(s, d), k, **o), sql)

    def page(spark, sf_dir):
        with _session(spark) as e:
            d = e.upload_df(nation(spark, sf_dir))
            board = Dashboard("Nations").add("rows", d.shape()["shape"][0]).add("names", d.frame.select("n_name")).add("pie", d.pie(names="n_regionkey"), width=2)
            html = board.render()
            shown = sum(f"<td>{r[0]}</td>" in html for r in d.frame.select("n_name").collect())
            return _rows(spark, [(x["title"], x["kind"], x["row"], x["column"], shown if x["kind"] == "table" else None) for x in board.design()], "title string, kind string, at_row int, at_column int, shown bigint")

    add("ds_dashboard", page, "SELECT * FROM (VALUES ('rows', 'metric', 0, 0), ('names', 'table', 0, 1), ('pie', 'figure', 1, 0)) t(title, kind, at_row, at_column), (SELECT count(*) AS n FROM nation) SELECT title, kind, at_row, at_column, CASE kind WHEN 'table' THEN n END AS shown".replace("SELECT * FROM", "FROM", 1))

    def chatted(spark, sf_dir):
        with _session(spark) as e:
            d = e.upload_df(customer(spark, sf_dir))
            e.set_active(d.data_id)
            e.enable_agent(lambda prompt, about, have: [Step("mean", {"column": "c_acctbal"}), Step("nunique", {"column": "c_mktsegment"}, [0])])
            found = e.chat("?")["results"]
            return _rows(spark, [(round(float(found[0]), 4), int(found[1]), "2. nunique" in e.dashboard("?").render())], "mean double, segments bigint, on_page boolean")

    add("ds_chat", chatted, "SELECT round(avg(c_acctbal), 4) AS mean, count(DISTINCT c_mktsegment) AS segments, true AS on_page FROM customer")
    add("ds_tools", lambda s, d: _rows(s, [(t["name"],) for t in tools() if t["name"] in ("fillna", "iloc", "corr", "resample", "update")], "name string"), "SELECT unnest(['fillna', 'iloc', 'corr', 'resample', 'update']) AS name")

    def context(spark, sf_dir):
        with _session(spark) as e:
            about = profile(Agent(e.upload_df(nation(spark, sf_dir))).dataset)["columns"]
            return _rows(spark, [(about["n_regionkey"]["min"], about["n_regionkey"]["max"], "|".join(sorted(about["n_name"]["values"])))], "least int, most int, names string")

    add("ds_context", context, "SELECT min(n_regionkey)::INT AS least, max(n_regionkey)::INT AS most, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation")
