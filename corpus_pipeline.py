"""A corpus pipeline of five of the training-data operators, each stage over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns rows that are written as
Parquet and read again for the next one. An empty table goes through all stages
as an empty one; texts of any length count whole; columns beyond those of
documents stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekit.llm import bpe, langid, mixing, simhash, toxicity
from framekit.llm.common import discard, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the network learns from this input's labelled documents.

    NULL texts and texts without words aren't toxic and stay, and so do repeated
    rows. Without labels of both classes nothing is rejected.
    """
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _own(docs, toxicity.score(_boxed(docs), net, "__text").where(F.col("toxicity") < toxicity.THRESHOLD))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in one learned language or in a mixture of them.

    NULL texts and texts without letters go; repeated rows stay. Without any
    language to learn every document goes.
    """
    found = langid.identify(_boxed(docs), langid.fit(docs), "__text")
    return _own(docs, found.where(F.col("lang_pred") != langid.UNKNOWN))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id.

    NULL and empty texts are one group. Of rows that share the least id one
    stays; a group without any id keeps one row.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources takes them.

    NULL sources are a source; NULL and empty texts are never taken; repeated
    rows count each.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and digests of them and of the text that they decode to.

    NULL and empty texts have no tokens; repeated rows each get their result.
    """
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], tables=bpe.SMALL_TABLES)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def _boxed(docs: DataFrame) -> DataFrame:
    """The rows in one struct beside their text, so that no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]).alias("__row"), F.col("text").alias("__text"))


def _own(docs: DataFrame, boxed: DataFrame) -> DataFrame:
    return boxed.select(*[F.col("__text").alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models and byte-pair merges are beyond SQL; the tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # Only the newest of the stages' tables is read on.
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
