"""Mixing sources to target weights, with DataFrame functions only.

Rows get hash-random keys. Equal ranges of the keys hold about as many rows
each, so a source's rows are sorted range by range, and a prefix sum is the sum
of the ranges before plus a running sum within the range; no source, however
large, is one task's work. Every source is cut at its exact budget of words,
after as many whole epochs as fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that a range of keys should hold, and the most times a source may be read.
RANGE_ROWS, EPOCHS = 400, 3
WEIGHTS = (1, 2, 3)
SEED = 8
#: Bits of a key.
KEY_BITS = 60
#: Most ranges of keys in a source.
MAX_RANGES = 1 << 20
#: What stands after all sizes of rows without an id.
NO_TIE = 1 << 62


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for NULL."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    n = F.size(parts)
    edges = (parts[0] == "").cast("int") + F.when(n > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(n - edges).cast("bigint")


def random_key(row_id: Column, seed: int = SEED) -> Column:
    """60 random bits for an id: the start of an MD5 of seed and id, which SQL elsewhere can repeat; 0 for NULL."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"))
    return F.coalesce(F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint"), F.lit(0))


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, NULL last, take the weights in turn and share all
    words by them. No target passes ``epochs`` times its source's size: in order
    of that cap a weight, the sources that reach their cap are a prefix, and the
    others share what the prefix leaves by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("bigint")).withColumn("cap", F.col("source_size") * epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.select("*", before.alias("before"), later.alias("later"), F.row_number().over(by_cap).alias("turn"), F.sum("source_size").over(everything).alias("words"))
    level = level.withColumn("share", (F.col("words") - F.col("before")).cast("double") / F.col("later"))
    # The first source, in that order, whose cap isn't reached sets the share of one weight.
    level = level.withColumn("free", F.col("share") * F.col("weight") <= F.col("cap"))
    level = level.withColumn("one", F.min_by("share", F.when(F.col("free"), F.col("turn"))).over(everything))
    target = F.when(F.col("free"), F.col("one") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return level.select("source", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = SEED,
    unit: str = "word",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, size, source_size, target, taken): how many words the mix takes of every row.

    Whole epochs take every row; the rest of a source's budget, ``target``
    rounded, is taken from its rows in key order. With ``unit="word"`` the row at
    the budget's end gives just the words that are left; with ``unit="document"``
    it is taken whole if half of it fits, so ``taken`` is a multiple of ``size``.
    Rows of NULL source are a source of their own; NULL and empty texts have size
    0 and are never taken; repeated rows count each. An empty table gives an
    empty one. Keys depend on id and seed only, so reruns agree; rows that tie on
    key and size are interchangeable. Texts of any length count whole. Rows without
    an id are dealt out by size, as they share a key. ``keep`` names input columns to carry
    along in one struct, ``row``, whatever their names.
    """
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        # Never NULL, so that one shuffle serves the join and the window.
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("n")).alias("part"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        random_key(F.col(f"`{id_col}`"), seed).alias("key"),
        *([F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("row")] if keep else []),
    )
    whole_rows, rows = rows, materialize(rows.drop("row"), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = materialize(targets(totals.select("source", "source_size"), weights, epochs), "targets")
    # As many ranges for all sources as the largest needs; a range is the key's top bits.
    largest = totals.agg(F.max("n")).first()[0] or 0
    bits = max(0, min(MAX_RANGES, -(-largest // RANGE_ROWS)) - 1).bit_length()
    range_of = F.shiftright(F.col("key"), KEY_BITS - bits) if bits else F.lit(0).cast("bigint")
    # Rows without an id share one key, the least: their sizes, which come next in order, deal them out.
    tie_of = F.when(F.col("id").isNull(), F.col("size")).otherwise(F.lit(NO_TIE))
    ranged = rows.withColumn("range", range_of).withColumn("tie", tie_of)
    # Carried columns come from the input again rather than through another table.
    moved = whole_rows.withColumn("range", range_of).withColumn("tie", tie_of) if keep else ranged
    sums = ranged.groupBy("part", "range", "tie").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("part").orderBy("range", "tie").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", "range", "tie", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    plan = plan.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("p"), "source_size", "target")
    offsets = sums.join(plan, F.col("part") == F.col("p")).select("p", F.col("range").alias("r"), F.col("tie").alias("t"), "offset", "source_size", "target")
    # Ranges grow with the corpus: merging keeps one plan at every size, and its shuffle serves the window.
    joined = moved.join(offsets.hint("merge"), (F.col("part") == F.col("p")) & (F.col("range") == F.col("r")) & (F.col("tie") == F.col("t")))
    inside = Window.partitionBy("part", "range", "tie").orderBy("key", "size", F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = joined.withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    budget = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    left = budget - whole * F.col("source_size") - F.col("start")
    if unit == "document":
        last = F.when((F.col("size") > 0) & (left * 2 >= F.col("size")), F.col("size")).otherwise(0)
    else:
        last = F.greatest(F.lit(0), F.least(left, F.col("size")))
    taken = F.least(whole * F.col("size") + last, F.col("size") * epochs)
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("bigint").alias("taken"), *(["row"] if keep else []))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: whole rows of ``df``, each as often as the mix takes it."""
    taken = mix(df, id_col, source_col, text_col, unit="document", keep=df.columns, **options)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return taken.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")


#: The query's rows in SQL: the same keys, prefix sums and cuts.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         coalesce(substr(md5('8:' || CAST(doc_id AS VARCHAR)), 1, 15), '000000000000000') AS k
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM t),
l AS (
  SELECT *, row_number() OVER o AS turn,
         CAST((SELECT sum(source_size) FROM t) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST)),
one AS (SELECT arg_min(share, turn) AS one FROM l WHERE share * weight <= cap),
g AS (SELECT source, source_size, least(CASE WHEN share * weight <= cap THEN one * weight ELSE CAST(cap AS DOUBLE) END, CAST(cap AS DOUBLE)) AS target FROM l, one),
p AS (
  SELECT d.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       CAST(least(whole * size + greatest(0, least(budget - whole * source_size - start, size)), 3 * size) AS BIGINT) AS taken
FROM e
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
