"""One dataset: named operations on its rows, each also as an async twin (``a`` before the name)."""

from __future__ import annotations

import asyncio
import functools
import json
from collections import namedtuple
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import DataFrame

from .errors import OperationError
from .functions.expressions import col
from .lineage import Call, chained, signature, unique
from .operators import arithmetic as A
from .operators import cleaning as C
from .operators import inspection as I
from .operators import selection as S
from .operators import stats as X

if TYPE_CHECKING:
    from .engine import Engine

#: The hidden column of a row's place.
POSITION = "__pos"
#: Steps that a dataset's plan may hold before its rows are written.
STEPS = 12


def recorded(deep: bool | None = None, changes: bool = False) -> Callable:
    """Log a call; with ``deep`` store its result and replay it for the same call on the same version.

    A version is all the calls that made the rows what they are, in whatever
    session, so a stored result is found again only where they were the same.
    A call that ``changes`` the rows does so on a replay as well. A call's own
    ``deep`` wins over the session's; a session that says False stores nothing.
    """

    def wrap(method: Callable) -> Callable:
        @functools.wraps(method)
        def call(self: Dataset, *args: Any, **kwargs: Any) -> Any:
            session = self.engine.deep_cache
            store = False if session is False else deep if deep is not None else bool(session)
            name, lineage, version = method.__name__, self.engine.lineage, self.version
            hit = lineage.find(self.data_id, name, args, kwargs, version) if store else None
            if hit is None and changes and store and self._last == (name, signature(args), signature(kwargs)):
                # The same call again, on the rows that it has changed already.
                hit = next((c for c in reversed(lineage.of(self.data_id)) if c.is_deep_cache and c.version == self._before and (c.method_name, c.args, c.kwargs) == self._last), None)
                if hit is not None:
                    return self._visible(self.engine.stored(hit))
            result = method(self, *args, **kwargs) if hit is None or changes else None
            if changes:
                self._chain(name, args, kwargs)
            if hit is not None:
                return self._visible(self.engine.stored(hit))

            def keep(entry: Call) -> str:
                table = f"{self.data_id}_{entry.opidx}"
                result.write.mode("overwrite").parquet(f"{self.engine.warehouse}/{table}")
                return table

            lineage.record(self.data_id, name, args, kwargs, version, keep if store and isinstance(result, DataFrame) else None)
            return self._visible(result) if isinstance(result, DataFrame) else result

        return call

    return wrap


def changing(method: Callable) -> Callable:
    """A call that isn't logged but changes the rows."""

    @functools.wraps(method)
    def call(self: Dataset, *args: Any, **kwargs: Any) -> Any:
        result = method(self, *args, **kwargs)
        # What another frame holds isn't told by the call.
        self._chain(method.__name__, args, kwargs, method.__name__ != "update")
        return result

    return call


def _attributes(df: DataFrame) -> dict[str, str]:
    """What each column is in the plan: another thing wherever it was made anew, also under an old name."""
    out = df._jdf.queryExecution().analyzed().output()
    return {out.apply(i).name(): out.apply(i).exprId().toString() for i in range(out.size())}


def _one(df: DataFrame) -> Any:
    row = df.first()
    return row[0] if row is not None else None


class Dataset:
    """A dataset's rows and what can be done with them.

    Frames come back as Spark frames without the hidden place; ``to_pandas``
    collects them. Operations that make columns also add them to the dataset,
    which is then a new version of it.
    """

    def __init__(self, engine: Engine, data_id: str, df: DataFrame):
        self.engine, self.data_id, self.df, self.version = engine, data_id, df, ""
        self.index_columns: list[str] = []
        self._steps: list[list[Any]] = []
        self._last, self._before = None, ""

    # Plumbing

    def _visible(self, df: DataFrame) -> DataFrame:
        """A result in the rows' order, where it still has their places."""
        return df.orderBy(POSITION).drop(POSITION) if POSITION in df.columns else df

    @property
    def frame(self) -> DataFrame:
        """All rows, without their places and in no order."""
        return self.df.drop(POSITION)

    @property
    def rows(self) -> DataFrame:
        """All rows in order, without their places."""
        return self._visible(self.df)

    def _order(self) -> str:
        if POSITION not in self.df.columns:
            raise OperationError("the rows of a table read in place have no order")
        return POSITION

    def _chain(self, name: str, args: Any, kwargs: Any, known: bool = True) -> None:
        """Take a call that changed the rows into their version, and keep it for later sessions.

        Calls that can be repeated are steps; after STEPS of them, or one that
        can't be (other frames, the present time), the rows are written.
        """
        self._last, self._before = (name, signature(args), signature(kwargs)), self.version
        self.version = chained(self.version, name, args, kwargs) if known else unique()
        try:
            step = json.loads(json.dumps([name, list(args), kwargs]))
            same = known and step == [name, list(args), kwargs] and "now" not in [*map(str, args), *map(str, kwargs.values())]
        except (TypeError, ValueError):
            same = False
        self._steps = [*self._steps, step] if same and len(self._steps) < STEPS - 1 else []
        self.engine.save(self, self._steps or None)

    def resume(self, steps: Sequence[Sequence[Any]], version: str) -> Dataset:
        """The rows as an earlier session left them."""
        for name, args, kwargs in steps:
            method = getattr(type(self), name)
            getattr(method, "__wrapped__", method)(self, *args, **kwargs)
        self._steps, self.version = [list(s) for s in steps], version
        return self

    def _derive(self, df: DataFrame, involved: Sequence[str], target: str | None = None) -> DataFrame:
        """Take over a new column; the result is what it was made from and itself."""
        before, after = _attributes(self.df), _attributes(df)
        new = target or next(c for c in reversed(df.columns) if before.get(c) != after[c])
        self.df = df
        names = dict.fromkeys([c for c in involved if c in df.columns] + [new])
        return df.select(*[col(c) for c in names], *([col(POSITION)] if POSITION in df.columns else []))

    def to_pandas(self) -> pd.DataFrame:
        rows = self.df.orderBy(POSITION) if POSITION in self.df.columns else self.df
        return rows.drop(POSITION).toPandas()

    # Inspection

    def head(self, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
        return self._visible(I.head(self.df, n, columns or self.columns(), self._order()))

    def tail(self, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
        return self._visible(I.tail(self.df, n, columns or self.columns(), self._order()))

    def sample(self, n: int = 10, columns: Sequence[str] | None = None, random_state: int | None = None) -> DataFrame:
        return self._visible(I.sample(self.df, n, columns or self.columns(), random_state, POSITION if POSITION in self.df.columns else None))

    @recorded()
    def info(self, approximate: bool = False) -> DataFrame:
        return I.info(self.frame, approximate)

    @recorded()
    def describe(self, columns: Sequence[str] | None = None) -> DataFrame:
        return I.describe(self.frame, columns)

    @recorded()
    def null_analysis(self, columns: Sequence[str] | str | None = None) -> DataFrame:
        return I.null_analysis(self.frame, columns)

    @recorded()
    def data_quality_missing_values(self, columns: Sequence[str]) -> dict[str, dict[str, float]]:
        rows = I.missing_values(self.frame, columns).collect()
        return {r[0]: {"total": r["total"], "non_null": r["non_null"], "missing": r["missing"], "missing_pct": r["missing_pct"]} for r in rows}

    @recorded()
    def data_quality_completeness_score(self, columns: Sequence[str]) -> dict[str, dict[str, float]]:
        return {r[0]: {"completeness": r[1]} for r in I.completeness(self.frame, columns).collect()}

    @recorded()
    def comprehensive_numeric_summary(self, columns: Sequence[str], most: int | None = None) -> DataFrame:
        return I.numeric_summary(self.frame, columns, most)

    @recorded()
    def statistical_profile_report(self, columns: Sequence[str]) -> dict[str, Any]:
        return {
            "completeness": {r[0]: {"completeness": r[1]} for r in I.completeness(self.frame, columns).collect()},
            "numeric": {r["column_name"]: r.asDict() for r in I.numeric_summary(self.frame, columns).collect()},
        }

    def full_table(self, columns: Sequence[str] | None = None, chunk_size: int | None = None) -> DataFrame | Iterator[pd.DataFrame]:
        """All rows in order, or an iterator of pandas frames of ``chunk_size`` rows that never holds more than one."""
        rows = self.df.orderBy(POSITION) if POSITION in self.df.columns else self.df
        rows = rows.select(*[col(c) for c in (columns or self.columns())])
        return rows if chunk_size is None else self._chunks(rows, chunk_size)

    @staticmethod
    def _chunks(rows: DataFrame, size: int) -> Iterator[pd.DataFrame]:
        if size <= 0:
            raise OperationError("chunk_size must be positive")

        def chunks() -> Iterator[pd.DataFrame]:
            held: list = []
            for r in rows.toLocalIterator():
                held.append(tuple(r))
                if len(held) == size:
                    yield pd.DataFrame(held, columns=rows.columns)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=rows.columns)

        return chunks()

    def astype(self, columns: Any = None, dtypes: Any = None, dtype_map: Mapping[str, str] | None = None) -> DataFrame:
        return I.astype(self.rows, columns, dtypes, dtype_map)

    @changing
    def insert(self, column: str, value: Sequence) -> DataFrame:
        return self._visible(self._derive(I.insert(self.df, column, value, self._order()), [], column))

    @recorded(True)
    def map(self, func: str, na_action: str | None = None, columns: Sequence[str] | None = None, datetime_action: str = "skip") -> DataFrame:
        return I.map_columns(self.rows, func, na_action, columns, datetime_action)

    @changing
    def rename(self, columns: Mapping[str, str]) -> DataFrame:
        self.df = I.rename(self.df, columns)
        return self.head() if POSITION in self.df.columns else self.frame.limit(10)

    def set_index(self, columns: Sequence[str] | str) -> str:
        names = [columns] if isinstance(columns, str) else list(columns)
        I.check_index(self.df, names)
        self.index_columns = names
        return "Index set"

    @changing
    def update(self, on: str, other: Dataset | DataFrame | str, overwrite: bool = True, errors: str = "ignore", schema: str | None = None) -> DataFrame:
        """Take over values of another dataset, of a frame, or of a catalog table by its name (in ``schema``)."""
        if isinstance(other, str):
            other = self.engine.spark.table(f"`{schema}`.`{other}`" if schema else other)
        source = other.frame if isinstance(other, Dataset) else other
        self.df = I.update(self.df, source, on, overwrite, errors)
        return self.head() if POSITION in self.df.columns else self.frame.limit(10)

    @recorded(True)
    def resample(self, time_column: str, rule: str, agg: str = "COUNT", value_column: str | None = None, label: str = "left", closed: str = "left") -> DataFrame:
        return I.resample(self.frame, time_column, rule, agg, value_column, label, closed)

    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != POSITION]

    def dtypes(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.df.schema.fields if f.name != POSITION}

    def shape(self) -> dict[str, tuple[int, int]]:
        return {"shape": (self.df.count(), len(self.columns()))}

    def values(self) -> dict[str, list[list]]:
        return {"values": [list(r) for r in self.full_table().collect()]}

    def items(self) -> Iterator[tuple[str, Iterator]]:
        return I.items(self.full_table())

    def iterrows(self) -> Iterator[tuple[int, dict]]:
        return ((i, r.asDict()) for i, r in enumerate(self.full_table().toLocalIterator()))

    def itertuples(self, index: bool = True, name: str = "Row") -> Iterator[tuple]:
        kind = namedtuple(name, (["Index"] if index else []) + self.columns(), rename=True)
        return (kind(*([i] if index else []), *r) for i, r in enumerate(self.full_table().toLocalIterator()))

    # Selection

    def at(self, row_label: Any, column_label: str, index_column: str | None = None) -> Any:
        index_column = index_column or (self.index_columns[0] if len(self.index_columns) == 1 else None)
        placed = POSITION in self.df.columns
        found = S.at(self.df, row_label, column_label, index_column or ("id" if "id" in self.columns() else self.columns()[0]), POSITION if placed else None).collect()
        if not found:
            raise OperationError(f"no row {row_label!r}")
        return found[0][0]

    def iat(self, row_position: int, column_label: str, order_by: str | Sequence[str]) -> Any:
        found = S.iat(self.df, row_position, column_label, order_by).collect()
        if not found:
            raise OperationError(f"no row at {row_position}")
        return found[0][0]

    def iloc(self, row_indexer: Any = None, col_indexer: Any = None, columns: Sequence[str] | None = None, index_column: str | None = None) -> Any:
        """Rows by place; a single cell comes back as its value."""
        if isinstance(row_indexer, tuple):
            row_indexer, col_indexer = row_indexer
        names = S.iloc_columns(self.frame, columns if columns is not None else col_indexer)
        out = S.iloc(self.df, row_indexer, names, self._order(), True, index_column)
        if isinstance(row_indexer, int) and not isinstance(row_indexer, bool) and isinstance(col_indexer, (int, str)) and ":" not in str(col_indexer):
            return _one(out)
        return out

    def get(self, keys: Sequence[str] | str, default: Any = None) -> DataFrame:
        return S.get(self.rows, keys, default)

    @recorded(True)
    def _select_dtypes(self, include: Any = None, exclude: Any = None) -> DataFrame:
        return S.select_dtypes(self.rows, include, exclude)

    def select_dtypes(self, include: Any = None, exclude: Any = None, chunk_size: int | None = None) -> DataFrame | Iterator[pd.DataFrame]:
        """Columns by type, in alphabetical order; in pandas frames of ``chunk_size`` rows if asked for."""
        out = self._select_dtypes(include, exclude)
        return out if chunk_size is None else self._chunks(out, chunk_size)

    def asof(self, where: Any, on: str, subset: Sequence[str] | str | None = None, chunk_size: int | None = None) -> pd.Series | pd.DataFrame | Iterator[pd.DataFrame]:
        """The last full row at or before a value (a Series), or before each of several (a frame, or chunks of one)."""
        tie = [POSITION] if POSITION in self.df.columns else []
        rows = S.asof(self.df, where, on, subset or self.columns(), tie).drop(POSITION, "lookup")
        if chunk_size is not None:
            return self._chunks(rows, chunk_size)
        found = rows.toPandas()
        return found if isinstance(where, (list, tuple)) else found.iloc[0]

    # Cleaning

    def _filling(self, method: str) -> str | None:
        return self._order() if method.lower() in ("ffill", "bfill") else None

    @recorded(True, True)
    def fillna(self, column: str, value: Any = None, method: str = "mean", mapping: Mapping | None = None, dtype: str | None = None) -> DataFrame:
        return self._derive(C.fillna(self.df, column, value, method, mapping, dtype, self._filling(method)), [column])

    @recorded(True, True)
    def groupby_fillna(self, column: str, group_cols: Sequence[str], value: Any = None, method: str = "mean", dtype: str | None = None) -> DataFrame:
        keys = [group_cols] if isinstance(group_cols, str) else list(group_cols)
        return self._derive(C.groupby_fillna(self.df, column, keys, value, method, dtype, self._filling(method)), [column, *keys])

    @recorded(True, True)
    def clip(self, column: str, lower: Any = None, upper: Any = None) -> DataFrame:
        return self._derive(C.clip(self.df, column, lower, upper), [column])

    @recorded(True, True)
    def drop_outliers(self, column: str, z_thresh: float = 3.0) -> DataFrame:
        return self._derive(C.drop_outliers(self.df, column, z_thresh), [column])

    @recorded(True, True)
    def to_numeric(self, column: str) -> DataFrame:
        """Retype a column in place: whole numbers as integers, others as doubles."""
        self.df = C.to_numeric(self.df, column, C.numeric_type(self.df, column))
        return self.df.select(col(column), *([col(POSITION)] if POSITION in self.df.columns else []))

    @recorded(True, True)
    def map_values(self, column: str, mapping: Mapping) -> DataFrame:
        return self._derive(C.map_values(self.df, column, mapping), [column])

    @recorded(True, True)
    def filter_valid(self, column: str, valid_values: Sequence) -> DataFrame:
        return self._derive(C.filter_valid(self.df, column, valid_values), [column])

    @recorded(True, True)
    def compress_rare(self, column: str, min_count: int = 10, other_label: str = "other") -> DataFrame:
        return self._derive(C.compress_rare(self.df, column, min_count, other_label), [column])

    @recorded(True, True)
    def fix_dates(self, column: str) -> DataFrame:
        return self._derive(C.fix_dates(self.df, column), [column])

    @recorded(True, True)
    def clip_dates(self, column: str, min_dt: Any = None, max_dt: Any = None) -> DataFrame:
        return self._derive(C.clip_dates(self.df, column, min_dt, max_dt), [column])

    @recorded(False)
    def dropna(self, axis: int = 0, how: str = "any", thresh: int | float | None = None) -> DataFrame:
        return C.dropna(self.df, axis, how, thresh, self.columns())

    @recorded(False)
    def drop(self, columns: Sequence[str] | str | None = None, axis: int = 0, index: Sequence[int] | int | None = None) -> DataFrame:
        if axis == 1 or (columns is not None and index is None):
            return C.drop_columns(self.df, [columns] if isinstance(columns, str) else list(columns or []))
        if index is None:
            raise OperationError("places of rows are needed")
        return C.drop_rows(self.df, [index] if isinstance(index, int) else list(index), self._order(), True)

    @recorded(False)
    def isna(self) -> DataFrame:
        return C.isna(self.rows)

    @recorded(False)
    def notna(self) -> DataFrame:
        return C.notna(self.rows)

    @recorded(True)
    def drop_duplicates(self, subset: Sequence[str] | str | None = None, keep: str | bool = "first") -> DataFrame:
        keys = [subset] if isinstance(subset, str) else list(subset or self.columns())
        return C.drop_duplicates(self.df, keys, keep, self._order())

    # Statistics

    def mode(self, column: str, top_n: int = 1) -> Any:
        found = [r[0] for r in X.mode(self.frame, column, top_n).collect()]
        return found if top_n != 1 else (found[0] if found else None)

    def unique(self, column: str) -> list:
        return [r[0] for r in X.unique(self.frame, column).collect()]

    def value_counts(self, column: str, top_n: int = 10) -> dict:
        return {r[0]: r[1] for r in X.value_counts(self.frame, column, top_n).collect()}

    def proportions(self, column: str) -> dict:
        return {r[0]: r[1] for r in X.proportions(self.frame, column).collect()}

    def quantile(self, column: str, q: float | Sequence[float] = (0.25, 0.5, 0.75)) -> dict[str, float]:
        qs = [q] if isinstance(q, (int, float)) else list(q)
        return {f"p_{round(r[0] * 100, 4):g}": r[1] for r in X.quantile(self.frame, column, qs).collect()}

    def autocorr(self, column: str, lag: int = 1) -> float | None:
        return _one(X.autocorr(self.df, column, self._order(), lag))

    def outliers_iqr(self, column: str) -> dict[str, Any]:
        return X.outliers_iqr(self.frame, column).first().asDict()

    @recorded(True)
    def outliers_zscore(self, column: str, threshold: float = 3.0) -> dict[str, Any]:
        return X.outliers_zscore(self.frame, column, threshold).first().asDict()

    def _square(self, long: DataFrame) -> pd.DataFrame:
        pdf = long.toPandas()
        names = list(dict.fromkeys(pdf["col_a"]))
        return pdf.pivot(index="col_a", columns="col_b", values="value").loc[names, names].rename_axis(index=None, columns=None)

    @recorded(True)
    def corr(self, columns: Sequence[str] | None = None) -> pd.DataFrame:
        return self._square(X.corr(self.frame, columns))

    @recorded(True)
    def cov(self, columns: Sequence[str] | None = None) -> pd.DataFrame:
        return self._square(X.cov(self.frame, columns))

    def crosstab(self, columns: Sequence[str]) -> dict[str, int]:
        return {"|".join(str(v) for v in r[:-1]): r[-1] for r in X.crosstab(self.frame, columns).collect()}

    @recorded(True, True)
    def datetime_diff(self, column: str, target_col: str | None = None) -> DataFrame:
        tie = [POSITION] if POSITION in self.df.columns else []
        return self._derive(X.datetime_diff(self.df, column, target_col, tie), [column], target_col or f"{column}__diff_seconds")

    def time_delta_stats(self, column: str) -> dict[str, Any]:
        return X.time_delta_stats(self.frame, column).first().asDict()

    def event_rate(self, column: str, unit: str = "day") -> float:
        return _one(X.event_rate(self.frame, column, unit))

    def time_unit_counts(self, column: str, unit: str = "day") -> dict[int, int]:
        return {r[0]: r[1] for r in X.time_unit_counts(self.frame, column, unit).collect()}

    def weekday_weekend_counts(self, column: str) -> dict[str, int]:
        return X.weekday_weekend_counts(self.frame, column).first().asDict()

    def holiday_counts(self, column: str) -> dict[str, int]:
        return {r[0]: r[1] for r in X.holiday_counts(self.frame, column).collect()}

    # Arithmetic beyond the tables below

    @recorded(True, True)
    def weighted_sum(self, col1: Any, col2: Any, weight1: float = 1, weight2: float = 1, target_col: str | None = None) -> DataFrame:
        return self._derive(A.weighted_sum(self.df, col1, col2, weight1, weight2, target_col), [col1, col2], target_col)

    @recorded(True, True)
    def percentage_change(self, old_col: Any, new_col: Any, target_col: str | None = None) -> DataFrame:
        return self._derive(A.percentage_change(self.df, old_col, new_col, target_col), [old_col, new_col], target_col)

    @recorded(True, True)
    def normalize_range(self, column: str, target_col: str | None = None) -> DataFrame:
        return self._derive(A.normalize_range(self.df, column, target_col), [column], target_col)

    # Plots and reports

    def plot(self, kind: str, **options: Any) -> Any:
        from .plots import plot

        return plot(self.frame, kind, **options)


def _binary(op: str) -> Callable:
    def method(self: Dataset, col1: Any, col2: Any, target_col: str | None = None) -> DataFrame:
        return self._derive(A.binary(self.df, op, col1, col2, target_col), [col1, col2], target_col)

    method.__name__, method.__doc__ = op, f"A new column: ``{op}`` of two columns, or of a column and a number."
    return recorded(True, True)(method)


def _unary(op: str) -> Callable:
    if op in ("round", "truncate"):

        def method(self: Dataset, column: str, digits: int = 0, target_col: str | None = None) -> DataFrame:
            return self._derive(A.unary(self.df, op, column, target_col, digits=digits), [column], target_col)
    else:

        def method(self: Dataset, column: str, target_col: str | None = None) -> DataFrame:
            return self._derive(A.unary(self.df, op, column, target_col), [column], target_col)

    method.__name__, method.__doc__ = op, f"A new column: ``{op}`` of a column."
    return recorded(True, True)(method)


def _statistic(name: str) -> Callable:
    def method(self: Dataset, column: str) -> Any:
        return _one(X.scalar(self.frame, column, name))

    method.__name__, method.__doc__ = name, f"The column's {name}, as a value."
    return method


def _twin(name: str) -> Callable:
    async def method(self: Dataset, *args: Any, **kwargs: Any) -> Any:
        return await asyncio.to_thread(getattr(self, name), *args, **kwargs)

    method.__name__, method.__doc__ = f"a{name}", f"``{name}`` without blocking the event loop."
    return method


for _name in (*A.BINARY, *A.ALIASES):
    setattr(Dataset, _name, _binary(_name))
for _name in A.UNARY:
    setattr(Dataset, _name, _unary(_name))
STATISTICS = ("count", "sum", "min", "max", "mean", "median", "nunique", "std", "var", "sem", "mad", "iqr", "range", "skew", "kurtosis", "entropy", "coefficient_of_variation", "product")
for _name in STATISTICS:
    setattr(Dataset, _name, _statistic(_name))
for _kind in ("bar", "bar_polar", "line", "pie", "scatter", "scatter_3d"):
    setattr(Dataset, _kind, functools.partialmethod(Dataset.plot, _kind))
#: Names of all public operations, each of which has an async twin.
OPERATIONS = sorted(n for n, f in vars(Dataset).items() if not n.startswith("_") and (callable(f) or isinstance(f, functools.partialmethod)))
# A twin never hides an operation: acos, asin, atan and asof stay themselves, and their twins take a second a.
for _name in OPERATIONS:
    if f"a{_name}" not in OPERATIONS:
        setattr(Dataset, f"a{_name}", _twin(_name))
