"""Language identification by multilingual mixture inference.

A document is a mixture of languages: every word of it comes from one of them.
Letter trigram models, one a language, give each word's likelihood; expectation
maximisation finds the proportions that make the document likeliest. Of the
nested sets made of its one, two, three, ... likeliest languages, the set with
the best likelihood after a penalty for each language is the document's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, held_out, within

#: Letter classes: 0 stands for what isn't a letter, FREQUENT classes for the
#: corpus's commonest letters, the rest for the other letters by code block.
CLASSES, FREQUENT = 64, 48
#: Labelled documents that a model may learn from, for each language.
SAMPLE_DOCS = 300
#: EM rounds; the price of one more language, in nats for each doubling of words.
ROUNDS, PENALTY = 12, 3.0
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """langs; class of each code point; log p(trigram's last letter | first two) by trigram and language."""

    langs: list[str]
    classes: np.ndarray
    logp: np.ndarray


def _letters(text: str) -> np.ndarray:
    """Code points of a lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _alphabet(texts: Sequence[str]) -> np.ndarray:
    """Class of each code point, from the letters of the sample."""
    counts = np.zeros(0x110000, np.int64)
    for t in texts:
        counts += np.bincount(_letters(t), minlength=0x110000)
    classes = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            classes[cp] = FREQUENT + 1 + (cp >> 7) % (CLASSES - FREQUENT - 1)
    seen = np.where(classes > 0, counts, 0)
    common = [int(cp) for cp in np.lexsort((np.arange(len(seen)), -seen))[:FREQUENT] if seen[cp]]
    for i, cp in enumerate(common, 1):
        classes[cp] = i
    return classes


def _trigrams(classes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram of each kept place and the places where words start.

    Runs of other characters count as one place of class 0, which belongs to the
    word before it; a text starts and ends with one.
    """
    c = classes[_letters(text)].astype(np.int32)
    c = np.concatenate(([0], c, [0]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    grams = (np.concatenate(([0], c[:-2])) * CLASSES + c[:-1]) * CLASSES + c[1:] if len(c) > 1 else np.zeros(0, np.int32)
    starts = np.flatnonzero(c[:-1] == 0)
    return grams, starts


def train(texts: Sequence[str], langs: Sequence[str]) -> LanguageModel:
    """Interpolated trigram models of all languages over one alphabet."""
    names = sorted(set(langs))
    classes = _alphabet(texts)
    size = CLASSES**3
    logp = np.zeros((size, len(names)), np.float32)
    for k, name in enumerate(names):
        n3 = np.zeros(size)
        for t, own in zip(texts, langs):
            if own == name:
                n3 += np.bincount(_trigrams(classes, t)[0], minlength=size)
        n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 0.5) / (n1.sum() + 0.5 * CLASSES)
        p2 = (n2 + 8 * p1) / (n2.sum(axis=1, keepdims=True) + 8)
        p3 = (n3 + 8 * p2) / (n3.sum(axis=2, keepdims=True) + 8)
        logp[:, k] = np.log(p3).reshape(-1)
    return LanguageModel(names, classes, logp)


def _em(words: np.ndarray, doc: np.ndarray, starts: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ROUNDS from ``start``, and the log likelihood that they give; words of likelihood 0 can't occur."""
    mix = start
    for _ in range(ROUNDS):
        joint = words * mix[doc]
        joint /= joint.sum(axis=1, keepdims=True)
        mix = np.add.reduceat(joint, starts, axis=0) / counts[:, None]
    return mix, np.add.reduceat(np.log((words * mix[doc]).sum(axis=1)), starts)


def infer(model: LanguageModel, texts: Sequence[str | None], penalty: float = PENALTY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, proportions) of each text; ``und``, 0 and none without letters."""
    k = len(model.langs)
    parts, lengths = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t and k:
            grams, starts = _trigrams(model.classes, t)
            if len(grams):
                parts.append(np.add.reduceat(model.logp[grams], starts, axis=0))
                lengths[i] = len(starts)
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    mixes = np.zeros((len(texts), k))
    live = np.flatnonzero(lengths)
    if not len(live):
        return names, score, mixes
    loglik = np.concatenate(parts).astype(np.float64)
    # No word rules a language out for good: a floor below the best one, as if the word might be foreign to it.
    best = loglik.max(axis=1, keepdims=True)
    words = np.exp(np.maximum(loglik - best, -25.0)).astype(np.float32)
    counts = lengths[live].astype(np.float32)
    starts = np.concatenate(([0], np.cumsum(lengths[live])[:-1]))
    doc = np.repeat(np.arange(len(live)), lengths[live])
    full, _ = _em(words, doc, starts, counts, np.full((len(live), k), 1 / k, np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    value, chosen = np.full(len(live), -np.inf), np.zeros((len(live), k))
    todo = np.arange(len(live))
    for size in range(1, k + 1):
        inside = rank[todo] < size
        if size == 1:
            mix = inside.astype(np.float32)
            own = np.add.reduceat(np.log((words * mix[doc]).sum(axis=1)), starts)
        else:
            # Only documents whose likelihood grew by more than the price so far try a larger set.
            pick = np.isin(doc, todo)
            n = lengths[live][todo]
            begin = np.concatenate(([0], np.cumsum(n)[:-1]))
            part = np.where(inside, np.maximum(full[todo], 1e-6), 0)
            mix, own = _em(words[pick], np.repeat(np.arange(len(todo)), n), begin, counts[todo], (part / part.sum(axis=1, keepdims=True)).astype(np.float32))
        own = own - penalty * size * np.log2(1 + lengths[live][todo])
        better = own > value[todo]
        value[todo[better]], chosen[todo[better]] = own[better], mix[better]
        todo = todo[better]
        if not len(todo):
            break
    top = chosen.argmax(axis=1)
    for i, t in zip(live, top):
        names[i] = model.langs[t]
    score[live] = np.clip(chosen[np.arange(len(live)), top], 0, 1)
    mixes[live] = chosen
    return names, score, mixes


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, each: int) -> tuple[list[str], list[str]]:
    """Whole texts and languages of at most ``each`` documents a language, outside the held-out fold, by hash order of ids.

    Every label is learned, and texts of any length are taken, up to
    ``SAMPLE_CHARS`` characters in all. Ids are ranked first, in one pass over
    all labels, so that texts of the chosen ones alone leave the scan.
    """
    able = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    able = able.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    # Of rows that repeat an id and a language the least counts.
    once = able.groupBy("lang", "id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    groups: dict[str, list] = {}
    sizes = {}
    for r in once.withColumn("place", place).where(F.col("place") <= each).orderBy("lang", "place").collect():
        groups.setdefault(r["lang"], []).append((r["lang"], r["id"]))
        sizes[r["lang"], r["id"]] = r["size"]
    chosen = set(within(sizes, groups))
    ids = sorted({i for _, i in chosen})
    if not ids:
        return [], []
    rows = able.where(F.col("id").isin(ids)).groupBy("lang", "id").agg(F.min("text").alias("text")).collect()
    rows = sorted(((r["id"], r["lang"], r["text"]) for r in rows if (r["lang"], r["id"]) in chosen and r["text"] is not None), key=lambda r: r[:2])
    return [r[2] for r in rows], [r[1] for r in rows]


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_mix", T.MapType(T.StringType(), T.DoubleType()))]


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, penalty: float = PENALTY) -> DataFrame:
    """Append ``lang_pred``, ``lang_score`` (its proportion) and ``lang_mix`` (all proportions over 0) for each whole text.

    NULL texts and texts without letters are ``und`` with score 0 and no mixture.
    No shuffle; repeated rows each get their result; an empty table gives an
    empty one; a model of no languages calls everything ``und``. Texts of any
    length count whole; input columns named like an output give way to it.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def apply(texts):
            names, score, mixes = infer(own, texts, penalty)
            found = [[(own.langs[j], float(row[j])) for j in np.flatnonzero(row > 1e-9)] for row in mixes]
            return {"lang_pred": names, "lang_score": score, "lang_mix": found}

        return apply

    return annotate(df, make, FIELDS, text_col, keep)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = SAMPLE_DOCS) -> LanguageModel:
    """A model from a bounded sample of the labelled documents outside the held-out fold."""
    return train(*training_sample(docs, id_col, text_col, lang_col, each))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_mix").alias("proportions"))
