"""The session: a warehouse folder of datasets, their registry and their lineage."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import POSITION, Dataset
from .errors import ConfigurationError, DataNotFoundError
from .lineage import Call, Lineage
from .sources import load_csv, load_frame, load_parquet
from .sources.connect import read_jdbc, write_jdbc
from .sources.names import clean_columns, new_id


class Engine:
    """Datasets of one Spark session.

    ``warehouse`` is a folder that driver and executors share; datasets are
    Parquet there. ``deep_cache`` is the session's answer to whether results are
    stored for replay; False turns replay off for every call.
    """

    def __init__(self, spark: SparkSession, warehouse: str | None = None, deep_cache: bool | None = None):
        self.spark, self.deep_cache = spark, deep_cache
        base = warehouse or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/framekit-{uuid.uuid4().hex[:8]}"
        self.warehouse = str(base).rstrip("/")
        self.active_id: str | None = None
        self.datasets: dict[str, Dataset] = {}
        self.registry: list[dict[str, Any]] = []
        self._superseded: list[str] = []
        self.lineage, self.planner = Lineage(), None
        self.connect()

    # Session

    def connect(self) -> Engine:
        """Open the warehouse: registry and lineage of earlier sessions come back."""
        self.registry = self._read_json("registry") or []
        self.lineage = Lineage(self._read_calls, self._write_call, lambda data_id: self._delete(f"lineage/{data_id}"))
        return self

    def enable_agent(self, planner: Any) -> None:
        """Set the callable that turns prompts into steps, for ``chat`` and ``dashboard``."""
        self.planner = planner

    def chat(self, prompt: str, data_id: str | None = None) -> dict[str, Any]:
        from .agent import Agent

        return Agent(self.dataset(data_id), self.planner).chat(prompt)

    def dashboard(self, prompt: str, data_id: str | None = None) -> Any:
        from .agent import Agent

        return Agent(self.dataset(data_id), self.planner).dashboard(prompt)

    def close(self) -> None:
        """End the session; tables that newer ones stand for go now, as frames may have read them until here."""
        while self._superseded:
            self._delete(self._superseded.pop())
        self.datasets.clear()
        self.active_id = None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    async def __aenter__(self) -> Engine:
        return self

    async def __aexit__(self, *_: object) -> None:
        self.close()

    def _path(self, name: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.warehouse}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_json(self, name: str) -> Any:
        where, system = self._path(f"{name}.json")
        if not system.exists(where):
            return None
        stream = system.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_json(self, name: str, value: Any) -> None:
        where, system = self._path(f"{name}.json")
        stream = system.create(where, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def _write_call(self, call: dict[str, Any]) -> None:
        self._write_json(f"lineage/{call['data_id']}/{call['opidx']:06}-{uuid.uuid4().hex[:8]}", call)

    def _read_calls(self) -> list[dict[str, Any]]:
        where, system = self._path("lineage")
        if not system.exists(where):
            return []
        found, each = [], system.listFiles(where, True)
        while each.hasNext():
            at = each.next().getPath()
            if at.getName().endswith(".json"):
                found.append(self._read_json(f"lineage/{at.getParent().getName()}/{at.getName().removesuffix('.json')}"))
        return found

    def stored(self, call: Call) -> DataFrame:
        """The stored result of a call."""
        return self.spark.read.parquet(f"{self.warehouse}/{call.generated_table_name}")

    def save(self, dataset: Dataset, steps: list[list[Any]] | None) -> None:
        """Keep what has become of a dataset: the steps since its table was written, or with None its rows as a new table.

        Rows of tables that are read in place are never written; their steps are
        kept as long as they can be repeated.
        """
        row = next(r for r in self.registry if r["data_id"] == dataset.data_id)
        if steps is None and not row["is_external"]:
            table, old = f"{dataset.data_id}_v{uuid.uuid4().hex[:8]}", row["table_name"]
            dataset.df.write.parquet(f"{self.warehouse}/{table}")
            dataset.df = self.spark.read.parquet(f"{self.warehouse}/{table}")
            row["table_name"] = table
            self._superseded.append(old)
        row["steps"], row["version"] = steps or [], dataset.version
        self._write_json("registry", self.registry)

    def _delete(self, name: str) -> None:
        where, system = self._path(name)
        system.delete(where, True)

    # Ingest

    def store(self, df: DataFrame, table: str) -> DataFrame:
        """Write rows with their places, 0 to n - 1, in the order they were read."""
        path = f"{self.warehouse}/{table}"
        if POSITION in df.columns:
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        # Each partition numbers its rows; the offsets are one number a partition.
        marked = df.withColumn("__mono", F.monotonically_increasing_id())
        marked.write.mode("overwrite").parquet(f"{path}__raw")
        raw = self.spark.read.parquet(f"{path}__raw")
        sizes = sorted(raw.groupBy(F.shiftright("__mono", 33).alias("p")).count().collect())
        ahead, offsets = 0, {}
        for p, n in sizes:
            offsets[p], ahead = ahead, ahead + n
        if offsets:
            start = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.shiftright("__mono", 33))
            place = start + F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
        else:
            place = F.lit(0).cast("bigint")
        raw.withColumn(POSITION, place.cast("bigint")).drop("__mono").write.mode("overwrite").parquet(path)
        self._delete(f"{table}__raw")
        return self.spark.read.parquet(path)

    def _register(self, df: DataFrame, filename: str) -> Dataset:
        data_id = new_id(r["data_id"] for r in self.registry)
        stored = self.store(df, data_id)
        return self._enter(data_id, filename, data_id, stored, "upload", False)

    def _enter(self, data_id: str, filename: str, table: str, df: DataFrame, schema: str, external: bool) -> Dataset:
        self.registry.append({"data_id": data_id, "filename": filename, "uploaded_at": datetime.now(UTC).isoformat(), "is_upload_success": True, "table_name": table, "row_count": df.count(), "schema": schema, "is_external": external, "steps": [], "version": ""})
        self._write_json("registry", self.registry)
        self.datasets[data_id] = Dataset(self, data_id, df)
        return self.datasets[data_id]

    def upload_csv(self, file_path: str, dtypes: Mapping[str, str] | None = None) -> Dataset:
        """A dataset from a CSV file with a header; types are found or fixed by ``dtypes``."""
        return self._register(load_csv(self.spark, file_path, dtypes), str(file_path).rsplit("/", 1)[-1])

    def upload_parquet(self, file_path: str, dtypes: Mapping[str, str] | None = None) -> Dataset:
        """A dataset from a Parquet file or folder."""
        return self._register(load_parquet(self.spark, file_path, dtypes), str(file_path).rsplit("/", 1)[-1])

    def upload_df(self, df: Any, filename: str | None = None, dtypes: Mapping[str, str] | None = None) -> Dataset:
        """A dataset from a pandas or Spark frame."""
        name = filename or f"dataframe_{datetime.now(UTC):%Y%m%d%H%M%S}.csv"
        if isinstance(df, DataFrame):
            return self._register(df.toDF(*clean_columns(df.columns)), name)
        return self._register(load_frame(self.spark, df, dtypes, POSITION), name)

    def upload_table(self, url: str, table: str, filename: str | None = None, **options: Any) -> Dataset:
        """A dataset from a table of another database, by JDBC; options are those of ``read_jdbc``."""
        df = read_jdbc(self.spark, url, table, **options)
        return self._register(df.toDF(*clean_columns(df.columns)), filename or table)

    def write_table(self, data_id: str | None, url: str, table: str, mode: str = "append", **options: str) -> None:
        """A dataset's rows into a table of another database."""
        write_jdbc(self.dataset(data_id).frame, url, table, mode, **options)

    def dataset(self, data_id: str | None = None, data: Any = None, columns: list[str] | None = None) -> Dataset:
        """The dataset of an id (the active one by default), or a new one of in-memory data."""
        if data_id is not None and data is not None:
            raise ConfigurationError("give an id or data, not both")
        if data is not None:
            if columns is not None:
                import pandas as pd

                data = pd.DataFrame(data, columns=columns)
            return self.upload_df(data)
        data_id = data_id or self.active_id
        row = next((r for r in self.registry if r["data_id"] == data_id), None)
        if row is None:
            raise DataNotFoundError(f"no dataset {data_id!r}" if data_id else "no active dataset")
        if data_id not in self.datasets:
            df = self.spark.table(row["table_name"]) if row["is_external"] else self.spark.read.parquet(f"{self.warehouse}/{row['table_name']}")
            self.datasets[data_id] = Dataset(self, data_id, df).resume(row.get("steps") or [], row.get("version") or "")
        return self.datasets[data_id]

    def register_tables(self) -> dict[str, list[dict[str, Any]]]:
        """Register the catalog's tables that have rows and aren't registered yet; they are read in place and never dropped."""
        out: dict[str, list[dict[str, Any]]] = {}
        known = {r["table_name"] for r in self.registry if r["is_external"]}
        for database in self.spark.catalog.listDatabases():
            for t in self.spark.catalog.listTables(database.name):
                name = f"`{database.name}`.`{t.name}`"
                if t.isTemporary or name in known or self.spark.table(name).limit(1).count() == 0:
                    continue
                data_id = new_id(r["data_id"] for r in self.registry)
                self._enter(data_id, t.name, name, self.spark.table(name), database.name, True)
                out.setdefault(database.name, []).append({"data_id": data_id, "table_name": t.name, "row_count": self.registry[-1]["row_count"]})
        return out

    # Registry

    def list_tables(self) -> list[dict[str, Any]]:
        """Ids and file names, the newest first."""
        rows = [r for r in self.registry if r["is_upload_success"]]
        return [{"data_id": r["data_id"], "filename": r["filename"]} for r in sorted(rows, key=lambda r: r["uploaded_at"], reverse=True)]

    def set_active(self, data_id: str) -> None:
        if not any(r["data_id"] == data_id for r in self.registry):
            raise DataNotFoundError(f"no dataset {data_id!r}")
        self.active_id = data_id

    def get_active_table(self) -> str | None:
        return self.active_id

    def delete_table(self, data_id: str | None = None, filename: str | None = None) -> None:
        """Drop a dataset, its stored results and its registry rows; external tables themselves stay."""
        rows = [r for r in self.registry if (data_id and r["data_id"] == data_id) or (filename and r["filename"] == filename)]
        if not rows:
            raise DataNotFoundError(f"no dataset {data_id or filename!r}")
        for r in rows:
            self.clear_cache(r["data_id"])
            if not r["is_external"]:
                self._delete(r["table_name"])
            self.registry.remove(r)
            self.datasets.pop(r["data_id"], None)
            if self.active_id == r["data_id"]:
                self.active_id = None
        self._write_json("registry", self.registry)

    def clear_cache(self, data_id: str) -> None:
        """Drop a dataset's stored results and lineage; the data stays."""
        for table in self.lineage.forget(data_id):
            self._delete(table)

    def list_operations(self, data_id: str | None = None) -> list[dict[str, Any]]:
        data_id = data_id or self.active_id
        if data_id is None:
            raise DataNotFoundError("no active dataset")
        return [{"opidx": c.opidx, "operation_type": c.operation_type, "method": c.method_name, "table_name": c.generated_table_name, "created_at": c.created_at} for c in self.lineage.of(data_id)]

    def retrieve_operation(self, data_id: str, opidx: int) -> str | None:
        """The stored table of one operation."""
        for c in self.lineage.of(data_id):
            if c.opidx == opidx:
                return c.generated_table_name
        raise DataNotFoundError(f"no operation {opidx} of {data_id!r}")
