"""A quality classifier by co-training of two views.

One classifier sees a page's text, the other its metadata. Both start from the
labelled documents. In each round one pass scores all unlabelled documents with
both, and each learns from every document that the other is sure of, through
sums of gradients and of bounds of the curvature. At last a calibration of both
views' log odds on labelled documents kept aside combines them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, discard, first_ids, held_out, kept, materialize, one_label, sample_rows, ship, slices

#: Labelled documents of each class that training may use at most.
SAMPLE_DOCS = 1200
#: Rounds of exchange, each a pass over all unlabelled documents.
ROUNDS = 5
#: Weight of a document handed over, and the most that all of them weigh, in shares of the labelled ones' weight.
HANDED, HANDED_MOST = 0.3, 0.3
#: Documents whose features are held at once, and groups that the tasks' sums are added up in.
BLOCK_DOCS, SUM_GROUPS = 2000, 16
BIGRAMS, META = 512, 256
#: Least probability at which a view is sure of a label.
SURE = 0.9


def _text_counts(text: str | None) -> tuple[np.ndarray, tuple]:
    """Numbers of byte pairs (hashed), and shares of kinds of characters, repetition of words and lines, lengths."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if not data:
        return np.zeros(BIGRAMS, np.int64), (0.0,) * 11 + (1.0,)
    b = np.frombuffer(data, np.uint8)
    pairs = (b[:-1].astype(np.uint32) * 2654435 + b[1:].astype(np.uint32) * 40503) % BIGRAMS
    n = np.bincount(b, minlength=256)
    total = len(b)
    words, lines = text.lower().split(), text.split("\n")
    return np.bincount(pairs, minlength=BIGRAMS), (
        n[65:91].sum() / total,
        n[97:123].sum() / total,
        n[48:58].sum() / total,
        n[128:].sum() / total,
        (n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum()) / total * 4,
        n[32] / total * 2,
        n[10] / total * 10,
        len(set(words)) / len(words) if words else 1.0,
        len(set(lines)) / len(lines),
        np.log1p(len(words)) / 10,
        sum(map(len, words)) / len(words) / 20 if words else 0.0,
        0.0,
    )


def _shares(counts: np.ndarray) -> np.ndarray:
    """Roots of each row's shares."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * 4


def text_features(text: str | None) -> np.ndarray:
    """Shares of byte pairs (hashed) and of kinds of characters, repetition of words and lines, lengths."""
    counts, rest = _text_counts(text)
    return np.concatenate((_shares(counts[None, :])[0], rest))


def meta_features(meta: Sequence) -> np.ndarray:
    """Hashed indicators of each metadata value (numbers by their size) and of pairs of them."""
    parts = []
    for i, v in enumerate(meta):
        if isinstance(v, (int, float)):
            v = f"~{np.log2(1 + abs(v)):.0f}"
        parts.append(f"{i}={v}")
    parts += [a + "&" + b for k, a in enumerate(parts) for b in parts[k + 1 :]]
    out = np.zeros(META)
    for p in parts:
        out[zlib.crc32(p.encode("utf-8", "surrogatepass")) % META] += 1
    return out


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def fit_logistic(X: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, rounds: int = 200, decay: float = 1e-3, more: tuple[float, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights (bias last) of a weighted logistic regression, by Adam over all rows.

    ``more`` are (weight, gradient, curvature) of further rows at ``start``.
    """
    X = np.concatenate((X, np.ones((len(X), 1))), axis=1)
    w = np.zeros(X.shape[1]) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    extra, slope, bend = more or (0.0, 0.0, 0.0)
    total = weight.sum() + extra or 1.0
    for k in range(1, rounds + 1):
        g = X.T @ (weight * (_sigmoid(X @ w) - y)) / total + decay * w
        if more:
            g += (slope + bend * (w - start)) / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


@dataclass
class CoTrained:
    """Weights of both views over centred features, and of the calibration (text, metadata, bias)."""

    centre: list[np.ndarray]
    views: list[np.ndarray]
    blend: np.ndarray

    def logits(self, k: int, X: np.ndarray) -> np.ndarray:
        return (X - self.centre[k]) @ self.views[k][:-1] + self.views[k][-1]

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = np.stack([np.clip(self.logits(0, text), -30, 30), np.clip(self.logits(1, meta), -30, 30), np.ones(len(text))], axis=1)
        return _sigmoid(z @ self.blend)


def handed_over(model: CoTrained, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Sums over the documents that one view is sure of, for the other one: their number, gradient and curvature.

    Views, then classes, in a row. The curvature is a diagonal that bounds the
    logistic loss's whole second derivative, so no step on it overshoots.
    """
    z, out = [model.logits(0, text), model.logits(1, meta)], []
    for k, X in enumerate((text, meta)):
        A = np.concatenate((X - model.centre[k], np.ones((len(X), 1))), axis=1)
        p, other = _sigmoid(z[k]), _sigmoid(z[1 - k])
        for c, sure in ((0, other <= 1 - SURE), (1, other >= SURE)):
            size = np.abs(A[sure])
            out += [[sure.sum()], A[sure].T @ (p[sure] - c), size.T @ size.sum(axis=1) / 4]
    return np.concatenate(out)


def pack(text: str | None, meta: Sequence) -> bytes:
    """A document's features in few bytes: byte pairs and metadata as counts, in the least whole numbers that hold them."""
    counts, rest = _text_counts(text)
    both = np.concatenate((counts, meta_features(meta).astype(np.int64)))
    return np.array(rest).tobytes() + both.astype(np.min_scalar_type(int(both.max()))).tobytes()


def unpack(packed: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of packed documents; those of one size are read together."""
    text, meta = np.zeros((len(packed), BIGRAMS + 12)), np.zeros((len(packed), META))
    sizes = np.array([len(x) for x in packed])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), size)
        counts = np.ascontiguousarray(raw[:, 96:]).view(f"u{(size - 96) // (BIGRAMS + META)}")
        text[at] = np.concatenate((_shares(counts[:, :BIGRAMS].astype(float)), np.ascontiguousarray(raw[:, :96]).view(np.float64)), axis=1)
        meta[at] = counts[:, BIGRAMS:]
    return text, meta


def _sums(model: CoTrained, texts: Sequence, metas: Sequence) -> np.ndarray:
    """``handed_over`` of documents in blocks."""
    total = np.zeros(sum(4 * len(w) + 2 for w in model.views))
    for a in range(0, len(texts), BLOCK_DOCS):
        text, meta = [text_features(t) for t in texts[a : a + BLOCK_DOCS]], [meta_features(m) for m in metas[a : a + BLOCK_DOCS]]
        total += handed_over(model, np.array(text), np.array(meta))
    return total


def _learn_from(sums: np.ndarray, k: int, width: int, labelled: float) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Weighted sums of both classes for one view; the classes weigh alike where there are enough documents."""
    at = 0 if k == 0 else len(sums) - 2 * (2 * width + 1)
    both = sums[at : at + 2 * (2 * width + 1)].reshape(2, -1)
    if not both[:, 0].any():
        return None
    u = np.minimum(HANDED, HANDED_MOST / 2 * labelled / np.maximum(both[:, 0], 1))
    return float(u @ both[:, 0]), u @ both[:, 1 : width + 1], u @ both[:, width + 1 :]


def train(texts: Sequence, metas: Sequence, y: Sequence[int], more_texts: Sequence = (), more_metas: Sequence = (), share: float | None = None, gather: Callable[[CoTrained], np.ndarray] | None = None) -> CoTrained:
    """Both views and their blend from labelled and unlabelled documents.

    ``gather`` gives the sums of ``handed_over`` over all unlabelled documents
    where they aren't in ``more_texts``. ``share`` is the share of class 1 among
    all labelled documents where the sample has another. Without both classes
    every document gets the share's side.
    """
    y = np.asarray(y, float)
    sizes = [BIGRAMS + 12, META]
    if gather is None and len(more_texts):
        gather = lambda model: _sums(model, more_texts, more_metas)
    X = [np.array([text_features(t) for t in texts]).reshape(-1, sizes[0]), np.array([meta_features(m) for m in metas]).reshape(-1, sizes[1])]
    if len(set(y.tolist())) < 2:
        return CoTrained([np.zeros(s) for s in sizes], [np.zeros(s + 1) for s in sizes], np.array([0.0, 0.0, 2.0 if y.any() else -2.0 if len(y) else 0.0]))
    centre = [x.mean(axis=0) for x in X]
    X = [x - c for x, c in zip(X, centre)]
    aside = np.zeros(len(y), bool)
    for c in (0.0, 1.0):
        own = np.flatnonzero(y == c)
        aside[own[::5]] = len(own) >= 10
    core = ~aside
    prior = y[core].mean()
    balance = np.where(y == 1, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9))
    views = [fit_logistic(X[k][core], y[core], balance[core]) for k in (0, 1)]
    out = CoTrained(centre, views, np.zeros(3))
    for _ in range(ROUNDS if gather else 0):
        sums = gather(out)
        more = [_learn_from(sums, k, len(views[k]), balance[core].sum()) for k in (0, 1)]
        out.views = views = [fit_logistic(X[k][core], y[core], balance[core], views[k], 60, more=more[k]) for k in (0, 1)]
    rest = np.flatnonzero(aside) if aside.any() else np.arange(len(y))
    z = np.stack([X[0][rest] @ views[0][:-1] + views[0][-1], X[1][rest] @ views[1][:-1] + views[1][-1]], axis=1).clip(-30, 30)
    out.blend = fit_logistic(z, y[rest], np.ones(len(rest)), np.array([0.5, 0.1, 0.0]), 400, 2e-3)
    if share is not None and 0 < share < 1 and 0 < y.mean() < 1:
        out.blend[2] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return out


def featurized(named: DataFrame, metas: int) -> DataFrame:
    """A table (id, packed) of the features of all rows (id, text, m0, ...), so that the rounds read texts once."""
    ship(named.sparkSession)
    rows = named.select("id", F.struct("text", *[f"m{i}" for i in range(metas)]).alias("page"))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            pages = batch.column(1).to_pylist()
            for a, b in slices(pages):
                packed = pa.array([pack(p["text"], tuple(p[f"m{i}"] for i in range(metas))) for p in pages[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), packed], names=["id", "packed"])

    schema = T.StructType([T.StructField("id", named.schema["id"].dataType), T.StructField("packed", T.BinaryType())])
    return materialize(rows.mapInArrow(run, schema), "features")


def _gather(named: DataFrame, labelled: set, metas: int) -> Callable[[CoTrained], np.ndarray]:
    """One pass over the features of all rows (id, text, m0, ...) whose id isn't labelled; tasks add up, then groups of tasks, then the driver."""
    sc = named.sparkSession.sparkContext
    rows = featurized(named, metas)
    ids = sc.broadcast(labelled)

    def gather(model: CoTrained) -> np.ndarray:
        shared, token = sc.broadcast(model), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]):
            own = kept(token, lambda: shared.value)
            total = None
            for batch in batches:
                packed = [p for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i not in ids.value]
                for a in range(0, len(packed), BLOCK_DOCS):
                    got = handed_over(own, *unpack(packed[a : a + BLOCK_DOCS]))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def add(table: pa.Table) -> pa.Table:
            parts = sorted(table["sums"].to_pylist())
            return pa.table({"sums": pa.array([np.sum([np.frombuffer(x) for x in parts], axis=0).tobytes()], pa.binary())})

        parts = rows.mapInArrow(run, "sums binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS)))
        found = sorted(r[0] for r in parts.groupBy("g").applyInArrow(add, "sums binary").collect())
        shared.unpersist()
        return np.sum([np.frombuffer(x) for x in found], axis=0) if found else _sums(model, [], [])

    gather.table = rows
    return gather


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = ("lang", "source", "n_chars"), label_col: str = "quality") -> CoTrained:
    """A classifier from a bounded sample, by hash order of ids, of labelled documents, and from all other documents.

    No document of the held-out fold is learned from, labelled or not. Texts of
    any length are taken, the labelled ones up to ``SAMPLE_CHARS`` characters in
    all. An id that is labelled both 0 and 1 counts as unlabelled.
    """
    able = one_label(labels, id_col, label_col)
    n = dict(able.groupBy("y").count().collect())
    groups = first_ids(able, SAMPLE_DOCS)
    label = {i: y for y, own in groups.items() for i in own}
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(meta_cols)])
    own = sample_rows(named, groups)
    total = sum(n.values())
    gather = _gather(named.where(~held_out(F.col("id"))), set(label), len(meta_cols))
    model = train([r[1] for r in own], [tuple(r[2:]) for r in own], [label[r[0]] for r in own], share=n.get(1, 0) / total if total else None, gather=gather)
    discard(gather.table)
    return model


FIELDS = [T.StructField("quality_score", T.DoubleType())]


def score(df: DataFrame, model: CoTrained, text_col: str = "text", meta_cols: Sequence[str] = ("lang", "source", "n_chars"), keep: list[str] | None = None) -> DataFrame:
    """Append ``quality_score``, the blend of both views, for each whole text and its metadata.

    NULL texts count as empty, NULL metadata as a value of its own. No shuffle;
    repeated rows each get their result; an empty table gives an empty one; an
    input column named like the output gives way to it. Texts of any length
    count whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (df.columns if keep is None else keep) if c.lower() != "quality_score"]
    page = F.struct(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(meta_cols)])
    rows = df.select(*[f"`{c}`" for c in names], page.alias("__page"))

    def make():
        own = shared.value

        def apply(pages):
            if not pages:
                return {"quality_score": []}
            text = np.array([text_features(p["text"]) for p in pages])
            meta = np.array([meta_features([p[f"m{i}"] for i in range(len(meta_cols))]) for p in pages])
            return {"quality_score": own.probability(text, meta)}

        return apply

    return annotate(rows, make, FIELDS, "__page", None).select(*[f"`{c}`" for c in names], "quality_score")


def op7_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
