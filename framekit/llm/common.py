"""What the training-data operators share: shared-folder tables and Arrow batching."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker holds at once (a single longer text still goes whole).
BLOCK_BYTES = 4 << 20
#: Characters of a model's training sample, shared alike by its groups (classes, languages); each group's last text is whole.
SAMPLE_CHARS = 32_000_000
#: Most bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. A session that names none takes the
    warehouse, which executors share as well, or, where driver and executors are
    one process (tests), a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        base = "file://" + tempfile.mkdtemp(prefix="framekit-shared-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for clusters where it isn't installed."""
    # Long texts must not make large batches: a session that sets no bound of its own gets this one.
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_framekit_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="framekit-package-")) / "framekit-package.zip"
    with zipfile.ZipFile(at, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(at))
    sc._framekit_shipped = True


#: What the operator that ran last in this Python worker keeps between its tasks.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gave for ``key`` in this worker before, or gives now.

    A worker serves one operator after another; each key puts the one before
    out, and its memory goes back to the system, so that tables never add up.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: later stages reread the files when an executor is lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framekit-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._framekit_path = path
    _written.append(path)
    if spark not in _sessions:
        _sessions.append(spark)
    return back


#: Tables that this session's operators wrote and haven't deleted, and the sessions that did.
_written: list[str] = []
_sessions: list[SparkSession] = []


@atexit.register
def _at_the_end() -> None:
    """No frame of this process reads its tables any more once it ends."""
    for spark in _sessions:
        with contextlib.suppress(Exception):  # a session that has stopped took its gateway along
            sweep(spark)


def sweep(spark: SparkSession) -> int:
    """Delete all tables that operators of this session wrote; call it when no result of theirs is read any more."""
    n = len(_written)
    while _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_framekit_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    with contextlib.suppress(ValueError):
        _written.remove(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 3; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model of labels may learn from."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of all ids that are labelled 0 or 1 and lie outside the held-out fold; ids labelled both have no label."""
    able = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    able = able.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    return able.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")


def first_ids(able: DataFrame, each: int) -> dict[int, list]:
    """Ids of either class, by hash order, ``each`` of a class at most."""
    return {y: [r[0] for r in able.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(each).select("id").collect()] for y in (0, 1)}


def within(sizes: dict[object, int], groups: dict[object, list], most: int | None = None) -> list:
    """Members of each group, in order, until the group's share of ``most`` characters is reached; the last one is whole."""
    share = (SAMPLE_CHARS if most is None else most) / max(1, len(groups))
    out = []
    for own in groups.values():
        used = 0
        for x in own:
            if x in sizes and used < share:
                out.append(x)
                used += sizes[x]
    return out


def sample_rows(rows: DataFrame, groups: dict[object, list], most: int | None = None) -> list:
    """One whole row (id, text, ...) of each id in ``groups`` that the sample's characters have room for, by id.

    Lengths come first, in a pass of their own, so that only chosen texts leave
    the executors. Of rows that repeat an id the least counts.
    """
    ids = sorted({x for own in groups.values() for x in own})
    if not ids:
        return []
    size = F.coalesce(F.length("text"), F.lit(0))
    sizes = dict(rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.max(size)).collect())
    chosen = sorted(within(sizes, groups, most))
    if not chosen:
        return []
    others = [c for c in rows.columns if c != "id"]
    least = rows.where(F.col("id").isin(chosen)).groupBy("id").agg(F.min(F.struct(*others)).alias("row"))
    return sorted(least.select("id", "row.*").collect(), key=lambda r: r[0])


def slices(texts: Sequence[str | None], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) runs of about ``most`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len((t.get("text") if isinstance(t, dict) else t) or "")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 64
    if start < len(texts):
        yield start, len(texts)


def annotate(
    df: DataFrame,
    make: Callable[[], Callable[[list], dict[str, Sequence]]],
    fields: Sequence[T.StructField],
    text_col: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns that a Python function derives from each whole text.

    ``make()`` runs once in each worker and gives the function, which turns a
    list of texts into one sequence a field. ``keep`` are the input columns that
    stay (all by default). An input column whose name clashes with an output
    field, in any case, gives way to the output. Every row stays, empty tables
    give empty tables.
    """
    ship(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    out_schema = T.StructType([*rows.schema.fields, *fields])
    if text_col in names:
        at = names.index(text_col)
    else:
        at, rows = len(names), df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text"))
    arrow_fields = _arrow_fields(fields)

    token = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kept(token, make)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts):
                got = apply(texts[a:b])
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                arrays += [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in arrow_fields]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *[f.name for f in arrow_fields]])

    return rows.mapInArrow(run, out_schema)


def _arrow_fields(fields: Sequence[T.StructField]) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
