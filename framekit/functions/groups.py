"""Rows meet their group's statistic, however few or large the groups are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import col

#: Groups that are few enough to be broadcast; of more, those with over one part in so many of the rows are.
FEW = 1000


def _same(keys: Sequence[Column], names: Sequence[str]) -> Column:
    out = F.lit(True)
    for k, n in zip(keys, names):
        out = out & k.eqNullSafe(F.col(n))
    return out


def meet(rows: DataFrame, keys: Sequence[Column], per: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``rows`` with the other columns of ``per``, which has one row for each group (__g0, __g1, ...); NULL keys are a group.

    Dealt by their keys, rows of few groups would be the work of as many tasks.
    A few groups are broadcast, so that rows stay where they are. Of many only
    the large ones are, and their rows stay dealt as they were read when the
    rest is joined by key. ``of`` has the same groups as ``rows`` and costs less.
    """
    names, away = [f"__g{i}" for i in range(len(keys))], [f"__h{i}" for i in range(len(keys))]
    values = [c for c in per.columns if c not in names]
    same = _same(keys, away)
    own = (rows if of is None else of).select(*[k.alias(n) for k, n in zip(keys, names)])
    if own.distinct().limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(per.withColumnsRenamed(dict(zip(names, away)))), same, "left").drop(*away)
    # Fewer than FEW groups can each have more than their share.
    large = rows.groupBy(*[k.alias(a) for k, a in zip(keys, away)]).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") * FEW > rows.count()).drop("__rows")
    hot = large.join(per, _same([F.col(n) for n in names], away), "left").select(*away, F.struct(*values).alias("__hot"))
    met = rows.join(F.broadcast(hot), same, "left").drop(*away)
    # Rows that have met theirs go by a number that nothing waits for.
    met = met.withColumn("__lot", F.when(F.col("__hot").isNotNull(), F.spark_partition_id() + 1).otherwise(0))
    # Always 0, but nothing that folds to a literal: the numbers would be no part of the key then.
    cold = per.select(*[F.col(n).alias(a) for n, a in zip(names, away)], F.struct(*values).alias("__cold"), F.least(F.spark_partition_id(), F.lit(0)).alias("__zero"))
    met = met.join(cold, same & (F.col("__lot") == F.col("__zero")), "left")
    return met.select(*[col(c) for c in rows.columns], *[F.coalesce(F.col("__hot")[v], F.col("__cold")[v]).alias(v) for v in values])
