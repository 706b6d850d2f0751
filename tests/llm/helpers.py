"""Odd documents that every operator must take, and plain forms of things to compare with."""

from __future__ import annotations

import re
from zlib import crc32

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `fp` string, `Score` string, `size` string, `verdict` string"


def odd_documents(spark):
    """NULLs in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    long = "alpha beta gamma delta " * 20000 + "end"
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, None, "en", "a", 0),
        (3, "", "en", "b", 0),
        (4, " \t\n ", None, "b", 4),
        (5, long, "en", "a", len(long)),
        (6, "der schnelle braune Fuchs springt über den faulen Hund", "de", "b", 54),
        (6, "der schnelle braune Fuchs springt über den faulen Hund", "de", "b", 54),
        (7, "12345 !!! ???", None, None, 13),
        (None, "a row without an id", None, None, 19),
        (None, None, None, None, None),
        (8, "the quick brown fox jumps over the lazy dog", "en", None, 43),
        (9, "\U0001f600 emoji é́ 日本語の文章", "ja", "c", 16),
        (10, "x", "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, "fp", "s", "z", "v") for r in rows], SCHEMA)


def documents(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    return spark.createDataFrame(rows, schema)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def held_out(doc_id) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 3 == 1


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}
