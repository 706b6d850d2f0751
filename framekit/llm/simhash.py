"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits share a variant within one bit
of both. So every distinct fingerprint emits itself and its 64 one-bit variants,
the variants are shuffled, and fingerprints that meet on one are compared.
A variant has at most 65 fingerprints around it, however many documents do.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, materialize
from .components import components

WORDS = 3
RADIUS = 2
SEED = 42
#: Shingles whose hashes are held at once.
BLOCK_SHINGLES = 1 << 17


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text.

    Lower-cases A-Z, splits at ASCII white space, hashes every shingle of
    ``words`` words, repeats included (all words if there are fewer; 0 if none),
    and sets the bits that over half of the hashes set.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    line = memoryview(b" ".join(parts))
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    starts.append(at)
    n, digest = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    span = min(words, len(parts))
    ones = np.zeros(64, np.int64)
    for a in range(0, n, BLOCK_SHINGLES):
        b = min(n, a + BLOCK_SHINGLES)
        h = np.fromiter([digest(line[i : j - 1], seed) for i, j in zip(starts[a:b], starts[a + span : b + span])], np.uint64, b - a)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """Append ``fp``, the fingerprint as a signed bigint; NULL texts count as empty (0)."""

    def make():
        def apply(texts):
            return {"fp": pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))}

        return apply

    return annotate(df, make, [T.StructField("fp", T.LongType())], text_col, keep)


def ball(fp: Column, radius: int) -> Column:
    """Array of all variants of a bigint within ``radius`` flipped bits."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (u, v) among distinct fingerprints (column ``fp``).

    Around each shared variant every fingerprint is linked to the least one
    there. The radius is even, so fingerprints around one variant are all within
    the radius of each other, and these links connect whatever any pair would.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    around = fps.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("variant"))
    pairs = around.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("other"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    return pairs.where((F.col("fp") > F.col("other")) & close).select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """rows (id, fp) with the root fingerprint of their class and its least id."""
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    stars = components(links(classes.select("fp"), radius))
    rooted = classes.join(stars, classes["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp", "left").select("id", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(id, fp, component_id): every row with the least id its fingerprint reaches.

    Rows with equal fingerprints are one class, found before any shuffle of
    variants, so copies cost no links. Rows with NULL ids take part and get
    their class's least id (NULL if it has none). Empty and NULL texts share
    fingerprint 0. Repeated rows each come back; empty tables give empty tables.
    Only the two columns named are read, so others may have any name; texts of
    any length count whole.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(with_fingerprints(rows, "text", ["id"], words), "fingerprints")
    return _classes(rows, radius).select(F.col("id").alias(id_col), F.col("fp").alias("fp"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row of each class of near-duplicates: the one with the least id.

    Keeps the input's columns. Of rows that share that id one stays. A class
    without any id keeps one row of its least fingerprint.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(with_fingerprints(rows, "text", ["id"], words), "fingerprints")
    near = _classes(rows, radius)
    keys = materialize(near.where("id is not null and id = component_id").groupBy("id").agg(F.count(F.lit(1)).alias("n")), "kept")
    # The kept ids grow with the corpus: merging keeps one plan at every size.
    named = df.join(keys.select(F.col("id").alias("__kept")).hint("merge"), F.col(f"`{id_col}`") == F.col("__kept"), "left_semi")
    if keys.where("n > 1").limit(1).count():
        named = named.dropDuplicates([id_col])
    if not rows.where("id is null").limit(1).count():
        return named
    alone = near.where("component_id is null").groupBy("root").agg(F.min("fp").alias("fp")).select(F.col("fp").alias("__kept"))
    unnamed = with_fingerprints(df.where(F.col(f"`{id_col}`").isNull()).withColumn("__row", F.struct(*[f"`{c}`" for c in df.columns])), text_col, ["__row"], words)
    unnamed = unnamed.join(alone, F.col("fp") == F.col("__kept"), "left_semi").dropDuplicates(["fp"]).select("__row.*")
    return named.unionByName(unnamed)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of all documents."""
    near = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
