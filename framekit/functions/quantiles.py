"""Exact quantiles at any size, by one method.

Spark's exact percentile keeps every distinct value in one task. Here approximate
quantiles bracket each rank first, for all columns and ranks in one pass; a
second pass counts the rows below and inside the brackets. What is inside is a
small share of the rows, and the exact percentile is taken of that alone; a
bracket that is still too large is cut again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import meet

#: Rows that are few enough for an exact percentile as they are, the same within a bracket, and one over the approximation's error.
SMALL_ROWS, FEW_ROWS, RANGES = 10_000, 10_000, 1000
#: The same for medians of groups, whose brackets are not cut again.
GROUP_RANGES = 10_000


def _ends(share: float, ranges: int | None = None) -> list[float]:
    """Shares on either side of one, further off than the approximation can err."""
    off = 2 / (ranges or RANGES)
    return [max(0.0, share - off), min(1.0, share + off)]


def _inside(c: Column, low: object, high: object) -> Column:
    return F.when((c >= F.lit(low)) & (c <= F.lit(high)), c)


class _Rank:
    """One quantile of one column: its place among the rows, and the bracket that holds it."""

    def __init__(self, column: Column, share: float, rows: int, ends: Sequence):
        self.column, self.rows = column, rows
        self.place = share * (rows - 1)
        self.least, self.most, self.low, self.high = ends
        self.below, self.within, self.open = 0, rows, rows > SMALL_ROWS

    def counts(self) -> list[Column]:
        return [F.count(F.when(self.column < F.lit(self.low), 1)), F.count(_inside(self.column, self.low, self.high))]

    def counted(self, below: int, within: int, before: int) -> None:
        """Take the bracket's counts; it opens up again where the approximation missed, and is done when it shrinks no more."""
        if below > math.floor(self.place) or below + within <= math.ceil(self.place):
            self.low, self.high, self.below, self.within, self.open = self.least, self.most, 0, self.rows, False
            return
        self.below, self.within = below, within
        self.open = within > FEW_ROWS and self.low != self.high and within <= 0.9 * before

    def approximate(self) -> Column:
        share = (self.place - self.below) / max(1, self.within - 1)
        return F.percentile_approx(_inside(self.column, self.low, self.high), _ends(share), RANGES)

    def value(self) -> Column:
        if not self.rows:
            return F.lit(None).cast("double")
        if self.low == self.high and self.within < self.rows:
            return F.lit(float(self.low))
        c = self.column if self.within == self.rows else _inside(self.column, self.low, self.high)
        return F.percentile(c, F.lit(min(1.0, (self.place - self.below) / max(1, self.within - 1))))


def quantiles(df: DataFrame, columns: Sequence[Column], shares: Sequence[float]) -> list[Column]:
    """For each column an array of its quantiles, to be used in an aggregate of ``df``.

    Two passes over ``df``, for all columns at once, find the brackets.
    """
    parts = []
    for i, c in enumerate(columns):
        ends = [e for s in shares for e in _ends(float(s))]
        parts += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"), F.percentile_approx(c, ends, RANGES).alias(f"q{i}")]
    one = df.agg(*parts).first()
    ranks = []
    for i, c in enumerate(columns):
        cuts = one[f"q{i}"] or [None] * 2 * len(shares)
        ranks.append([_Rank(c, float(s), one[f"n{i}"], (one[f"l{i}"], one[f"h{i}"], *cuts[2 * k : 2 * k + 2])) for k, s in enumerate(shares)])
    now = [r for own in ranks for r in own if r.open]
    while now:
        found = df.agg(*[x.alias(f"{k}{i}") for i, r in enumerate(now) for k, x in zip("bw", r.counts())]).first()
        for i, r in enumerate(now):
            r.counted(found[f"b{i}"], found[f"w{i}"], r.within)
        now = [r for r in now if r.open]
        if now:
            cuts = df.agg(*[r.approximate().alias(f"q{i}") for i, r in enumerate(now)]).first()
            for i, r in enumerate(now):
                r.low, r.high = cuts[f"q{i}"]
    return [F.array(*[r.value() for r in own]) for own in ranks]


def exact(df: DataFrame, column: Column, shares: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles of a column, as values."""
    return df.agg(quantiles(df, [column.cast("double")], shares)[0].alias("q")).first()[0]


def group_medians(df: DataFrame, keys: Sequence[Column], value: Column) -> DataFrame:
    """(__g0, __g1, ..., __s): the exact median of each group's values; NULL keys are a group, groups without values have none.

    Values are counted before they are gathered, and of a group only those that
    an approximation can't tell from the middle: a hot group isn't one task's work.
    """
    names = [f"__g{i}" for i in range(len(keys))]
    counted = df.select(*[k.alias(n) for k, n in zip(keys, names)], value.cast("double").alias("__v")).where("__v is not null")
    near = counted.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", _ends(0.5, GROUP_RANGES), GROUP_RANGES).alias("__ends"))
    near = near.select(*names, "__n", F.get("__ends", F.lit(0)).alias("__low"), F.get("__ends", F.lit(1)).alias("__high"))
    counted = counted.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__k"))
    inside = (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))
    joined = meet(counted, [F.col(n) for n in names], near, near).groupBy(*names).agg(
        F.first("__n").alias("__n"),
        F.coalesce(F.sum(F.when(F.col("__v") < F.col("__low"), F.col("__k"))), F.lit(0)).alias("__below"),
        F.sort_array(F.collect_list(F.when(inside, F.struct("__v", "__k")))).alias("__few"),
    )

    def at(rank: Column) -> Column:
        start = F.struct(F.col("__below").alias("seen"), F.lit(None).cast("double").alias("found"))

        def step(s: Column, x: Column) -> Column:
            seen = s["seen"] + x["__k"]
            return F.struct(seen.alias("seen"), F.coalesce(s["found"], F.when(seen > rank, x["__v"])).alias("found"))

        return F.aggregate("__few", start, step)["found"]

    low, high = F.floor((F.col("__n") - 1) / 2), F.ceil((F.col("__n") - 1) / 2)
    return joined.select(*names, ((at(low) + at(high)) / 2).alias("__s"))


def group_modes(df: DataFrame, keys: Sequence[Column], value: Column) -> DataFrame:
    """(__g0, __g1, ..., __s): the commonest value of each group, the least of equally common ones; values are counted before they meet."""
    names = [f"__g{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], value.alias("__v")).where("__v is not null")
    counted = rows.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__k"))
    best = F.min(F.struct((-F.col("__k")).alias("k"), F.col("__v").alias("v")))
    return counted.groupBy(*names).agg(best["v"].alias("__s"))
