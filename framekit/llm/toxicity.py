"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters as a word vector and the mean vector of its character
n-grams. Both directions of a gated recurrent network read windows of words;
attention weighs the places of a window, and a document is as toxic as its
worst window. All windows of every whole text are scored, each overlapping the
next by half. Training and scoring are numpy.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, first_ids, held_out, one_label, sample_rows

#: Words in a window and from one window to the next.
WINDOW, STRIDE = 32, 16
#: Width of a direction's state, of word vectors and of character vectors.
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
#: Known words at most, and hashed character n-grams.
VOCABULARY, CHAR_BUCKETS = 8000, 1 << 15
#: Labelled documents of each class that training may use at most.
SAMPLE_DOCS = 1200
EPOCHS, BATCH, BATCH_LEAST, STEPS = 12, 256, 32, 30
#: A document is toxic from this probability on.
THRESHOLD = 0.7
#: Pseudo-documents in a feature's first value, and documents that it must be in.
SHRINK, LEAST_DOCS = 4.0, 5
#: Words whose inputs a worker remembers.
MEMO_WORDS = 100_000

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def char_features(word: str) -> list[int]:
    """Buckets of a word's beginnings, its end and its inner 4-grams."""
    w = word.encode("utf-32-le", "surrogatepass")
    n = len(w) // 4
    parts = [b"^" + w[: 4 * k] for k in range(3, min(n, 7) + 1)]
    parts.append(b"$" + w[-12:])
    parts += [w[4 * i : 4 * i + 16] for i in range(0, min(n, 40) - 3)]
    crc = zlib.crc32
    return [crc(p) % CHAR_BUCKETS for p in parts]


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    starts[-1] = n - WINDOW
    return starts


@dataclass
class Network:
    vocabulary: dict[str, int]
    word_vectors: np.ndarray
    char_vectors: np.ndarray
    W: np.ndarray  # inputs to both directions' z, r and n
    bias: np.ndarray
    U: list[np.ndarray]  # states to z, r and n, for each direction
    v: np.ndarray  # attention
    w: np.ndarray  # logit
    b: np.ndarray
    platt: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    empty: float = 0.0  # share of class 1 among texts without words

    def inputs(self, words: Sequence[str]) -> np.ndarray:
        """Input of each word to z, r and n of both directions."""
        known = np.array([self.vocabulary.get(x, 0) for x in words], np.int64)
        feats = [char_features(x) for x in words]
        sizes = np.array([len(x) for x in feats])
        flat = np.array([y for x in feats for y in x], np.int64)
        chars = np.add.reduceat(self.char_vectors[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
        return (np.concatenate((self.word_vectors[known], chars), axis=1) @ self.W + self.bias).astype(np.float32)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Scorer:
    """Window logits of whole documents; remembers the inputs of words."""

    def __init__(self, net: Network):
        self.net, self.number = net, {}
        self.table, self.uses = np.zeros((0, 6 * HIDDEN), np.float32), np.zeros(0, np.int64)
        # sigmoid(x) = (tanh(x / 2) + 1) / 2: the halving of z and r is folded into the weights.
        half = np.concatenate((np.full(2 * HIDDEN, 0.5, np.float32), np.ones(HIDDEN, np.float32)))
        self.scale = np.concatenate((half, half))
        self.UT = [np.ascontiguousarray((u * half).T.astype(np.float32)) for u in net.U]
        self.heads = [np.stack((net.v[d * HIDDEN : (d + 1) * HIDDEN], net.w[d * HIDDEN : (d + 1) * HIDDEN])).astype(np.float32) for d in (0, 1)]

    def _forget(self) -> None:
        """Keep the words used most, half of the table at most."""
        keep = np.argsort(-self.uses, kind="stable")[: MEMO_WORDS // 2]
        keep = np.sort(keep[self.uses[keep] > 1])
        words = list(self.number)
        self.number = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.table, self.uses = self.table[keep], self.uses[keep] // 2

    def _numbers(self, docs: list[list[str]]) -> list[list[int]]:
        if len(self.number) > MEMO_WORDS:
            self._forget()
        number = self.number
        fresh = dict.fromkeys(w for d in docs for w in set(d).difference(number))
        if fresh:
            for w in fresh:
                number[w] = len(number)
            self.table = np.concatenate((self.table, self.net.inputs(list(fresh)) * self.scale))
            self.uses = np.concatenate((self.uses, np.zeros(len(fresh), np.int64)))
        look = number.__getitem__
        return [list(map(look, d)) for d in docs]

    def _direction(self, d: int, X: np.ndarray, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(step, attention score and logit share, window) of one direction."""
        H, B = HIDDEN, at.shape[1]
        h, out = np.zeros((H, B), np.float32), np.zeros((WINDOW, 2, B), np.float32)
        UT, heads = self.UT[d], self.heads[d]
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            x = X[:, at[t]]
            a = UT @ h
            g = np.tanh(x[: 2 * H] + a[: 2 * H])
            g += 1
            g *= 0.5
            n = a[2 * H :]
            n *= g[H:]
            n += x[2 * H :]
            np.tanh(n, out=n)
            new = h - n
            new *= g[:H]
            new += n
            if mask is not None:
                new *= mask[t]
            h = new
            out[t] = heads @ h
        return out

    def _logits(self, X: np.ndarray, starts: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        at = starts[None, :] + np.arange(WINDOW)[:, None]
        if mask is not None:
            at = np.where(mask > 0, at, 0)
        both = self._direction(0, X[: 3 * HIDDEN], at, mask) + self._direction(1, X[3 * HIDDEN :], at, mask)
        s, u = both[:, 0], both[:, 1]
        e = np.exp(s - s.max(axis=0))
        if mask is not None:
            e *= mask
        return (e * u).sum(axis=0) / e.sum(axis=0) + self.net.b[0]

    def windows(self, docs: Sequence[list[str]], most: int = 1 << 15) -> list[tuple[np.ndarray, np.ndarray]]:
        """(starts, logits) of the windows of each document's words; a long document is read in pieces."""
        out = []
        a = 0
        while a < len(docs):
            if len(docs[a]) > most:
                starts = windows_of(len(docs[a]))
                each = most // STRIDE
                parts = [starts[k : k + each] for k in range(0, len(starts), each)]
                logits = [self._block([docs[a][s[0] : s[-1] + WINDOW]], s - s[0])[0][1] for s in parts]
                out.append((starts, np.concatenate(logits)))
                a += 1
                continue
            b, n = a, 0
            while b < len(docs) and n + len(docs[b]) <= most:
                n += len(docs[b])
                b += 1
            out += self._block(docs[a:b])
            a = b
        return out

    def _block(self, docs: list[list[str]], starts: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``starts`` are the windows of a single document where they aren't its own."""
        numbers = self._numbers(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        offsets = np.cumsum(sizes) - sizes
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        self.uses += np.bincount(flat, minlength=len(self.uses))
        own = [windows_of(n) for n in sizes] if starts is None else [starts]
        X = np.ascontiguousarray(self.table[flat].T)
        logits = [np.zeros(len(o), np.float32) for o in own]
        long = np.flatnonzero(sizes > WINDOW)
        if len(long):
            first = np.concatenate([own[i] + offsets[i] for i in long])
            got = np.concatenate([self._logits(X, first[k : k + 4096], None) for k in range(0, len(first), 4096)])
            at = 0
            for i in long:
                logits[i] = got[at : at + len(own[i])]
                at += len(own[i])
        short = np.flatnonzero((sizes > 0) & (sizes <= WINDOW))
        if len(short):
            mask = (np.arange(WINDOW)[:, None] < sizes[short][None, :]).astype(np.float32)
            got = self._logits(X, offsets[short], mask)
            for i, x in zip(short, got):
                logits[i] = np.array([x], np.float32)
        return list(zip(own, logits))

    def documents(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(probability, first word of the worst window or -1) of each text; 0 without words."""
        raw, worst, many = np.zeros(len(texts)), np.full(len(texts), -1, np.int64), np.zeros(len(texts))
        for i, (starts, logits) in enumerate(self.windows([words_of(t) for t in texts])):
            if len(starts):
                j = int(logits.argmax())
                raw[i], worst[i], many[i] = logits[j], starts[j], len(starts)
        a, c, b = self.net.platt
        p = 1 / (1 + np.exp(-np.clip(a * raw + c * np.log(np.maximum(many, 1)) + b, -60, 60)))
        return np.where(many > 0, p, 0.0), worst


def _log_odds(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """From each feature's numbers of documents of either class: how much oftener it stands for class 1, in logs, drawn to 0 where they are few."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    odds = (pos + SHRINK * share) / (neg + SHRINK * (1 - share)) * (1 - share) / share
    return np.where(pos + neg >= LEAST_DOCS, np.clip(np.log(odds), -4, 4), 0.0)


class Trainer:
    def __init__(self, texts: Sequence[str], y: np.ndarray, seed: int = 3):
        self.rng, self.y = np.random.default_rng(seed), y
        # Documents are kept as numbers of words: each word's text and features are there once.
        index: dict[str, int] = {}
        self.ids = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in texts]
        self.words = list(index)
        share = float(y.mean()) if len(y) else 0.5
        docs = self._documents(self.ids, len(index))
        order = np.lexsort((np.array(self.words, dtype=object).astype(str), -docs.sum(axis=0))) if index else np.zeros(0, np.int64)
        known = [int(i) for i in order if docs[:, i].sum() >= LEAST_DOCS][:VOCABULARY]
        self.vocabulary = {self.words[i]: k for k, i in enumerate(known, 1)}
        self.known = np.zeros(len(index), np.int64)
        self.known[known] = np.arange(1, len(known) + 1)
        sizes, feats = [], []
        for w in self.words:
            f = char_features(w)
            sizes.append(len(f))
            feats.append(np.array(f, np.int32))
        self.sizes = np.array(sizes, np.int64)
        self.feats = np.concatenate(feats) if feats else np.zeros(0, np.int32)
        self.begin = np.cumsum(self.sizes) - self.sizes
        g = lambda *s: self.rng.normal(0, 0.1, s)
        D, H = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"E": g(len(known) + 1, WORD_DIM), "C": g(CHAR_BUCKETS, CHAR_DIM), "W": g(D, 6 * H) * 3, "bias": np.zeros(6 * H), "U0": g(H, 3 * H) * 2, "U1": g(H, 3 * H) * 2, "v": g(2 * H), "w": g(2 * H) * 3, "b": np.zeros(1)}
        # The first place of every vector starts from the feature's log odds.
        self.p["E"][0] = 0
        self.p["E"][1:, 0] = _log_odds(docs[1, known], docs[0, known], share) / 2
        chars = self._documents([self.feats[self._rows(np.unique(d))] for d in self.ids], CHAR_BUCKETS)
        self.p["C"][:, 0] = np.where(chars.sum(axis=0) > 0, _log_odds(chars[1], chars[0], share) / 2, self.p["C"][:, 0])
        self.moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        self.step = 0

    def _documents(self, of: list[np.ndarray], size: int) -> np.ndarray:
        """Numbers of documents of class 0 and of class 1 that have each feature."""
        n = np.zeros((2, size))
        for features, label in zip(of, self.y):
            n[int(label), np.unique(features)] += 1
        return n

    def _rows(self, words: np.ndarray) -> np.ndarray:
        """Places of the words' features."""
        sizes = self.sizes[words]
        return np.repeat(self.begin[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def network(self) -> Network:
        p = self.p
        f = lambda x: x.astype(np.float32)
        return Network(self.vocabulary, f(p["E"]), f(p["C"]), f(p["W"]), f(p["bias"]), [f(p["U0"]), f(p["U1"])], f(p["v"]), f(p["w"]), f(p["b"]))

    def _batch(self, windows: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        p, H, B, T = self.p, HIDDEN, len(windows), WINDOW
        ids, mask = np.zeros((T, B), np.int64), np.zeros((T, B, 1))
        for j, w in enumerate(windows):
            ids[: len(w), j], mask[: len(w), j] = w, 1
        uniq, inverse = np.unique(ids, return_inverse=True)
        inverse = inverse.reshape(-1)
        sizes = self.sizes[uniq]
        feats = self.feats[self._rows(uniq)]
        chars = np.add.reduceat(p["C"][feats], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        x = np.concatenate((p["E"][self.known[uniq]], chars), axis=1)
        X = (x @ p["W"] + p["bias"])[inverse].reshape(T, B, 6 * H)
        state, keep = np.zeros((T, B, 2 * H)), []
        for d in (0, 1):
            U, h, steps = p[f"U{d}"], np.zeros((B, H)), []
            for t in range(T) if d == 0 else range(T - 1, -1, -1):
                a, xt, m = h @ U, X[t, :, 3 * H * d : 3 * H * (d + 1)], mask[t]
                zr = _sigmoid(xt[:, : 2 * H] + a[:, : 2 * H])
                z, r, q = zr[:, :H], zr[:, H:], a[:, 2 * H :]
                n = np.tanh(xt[:, 2 * H :] + r * q)
                steps.append((t, h, z, r, q, n))
                h = m * ((1 - z) * n + z * h)
                state[t, :, H * d : H * (d + 1)] = h
            keep.append(steps)
        s = state @ p["v"] + np.where(mask[:, :, 0] > 0, 0, -1e9)
        e = np.exp(s - s.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * state).sum(axis=0)
        dlogit = (_sigmoid(pooled @ p["w"] + p["b"]) - y) / B
        dpooled = dlogit[:, None] * p["w"]
        dalpha = (state * dpooled).sum(axis=2)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        dstate = alpha[:, :, None] * dpooled + ds[:, :, None] * p["v"]
        g = {"w": pooled.T @ dlogit, "b": np.array([dlogit.sum()]), "v": np.tensordot(ds, state, ((0, 1), (0, 1)))}
        dX = np.zeros_like(X)
        for d in (0, 1):
            U, dU, carry = p[f"U{d}"], np.zeros((H, 3 * H)), np.zeros((B, H))
            for t, h, z, r, q, n in reversed(keep[d]):
                dh = (dstate[t, :, H * d : H * (d + 1)] + carry) * mask[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                da = np.concatenate((dz, dr, dn * r), axis=1)
                dX[t, :, 3 * H * d : 3 * H * (d + 1)] = np.concatenate((dz, dr, dn), axis=1)
                dU += h.T @ da
                carry = dh * z + da @ U.T
            g[f"U{d}"] = dU
        dwords = np.zeros((len(uniq), 6 * H))
        np.add.at(dwords, inverse, dX.reshape(T * B, -1))
        g["W"], g["bias"] = x.T @ dwords, dwords.sum(axis=0)
        dx = dwords @ p["W"].T
        self.step += 1
        for k, grad in g.items():
            self._adam(k, slice(None), grad, rate)
        self._sparse("E", self.known[uniq], dx[:, :WORD_DIM], rate)
        self._sparse("C", feats, np.repeat(dx[:, WORD_DIM:] / sizes[:, None], sizes, axis=0), rate)
        self.p["E"][0] = 0

    def _sparse(self, k: str, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        uniq, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(uniq), grads.shape[1]))
        np.add.at(total, inverse.reshape(-1), grads)
        self._adam(k, uniq, total, rate)

    def _adam(self, k: str, rows, grad: np.ndarray, rate: float) -> None:
        m, v = self.moments[k]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        scale = np.sqrt(1 - 0.99 ** min(self.step, 1000)) / (1 - 0.9 ** min(self.step, 1000))
        self.p[k][rows] -= rate * scale * m[rows] / (np.sqrt(v[rows]) + 1e-8)

    def run(self, part: np.ndarray, epochs: int = EPOCHS) -> None:
        """Train on the documents of ``part``: some windows of each at random first, the worst ones later."""
        docs = [i for i in part if len(self.ids[i])]
        for epoch in range(epochs):
            chosen: list[tuple[np.ndarray, int]] = []
            worst = None
            if epoch >= epochs // 3:
                scorer = Scorer(self.network())
                worst = scorer.windows([[self.words[j] for j in self.ids[i]] for i in docs])
            for k, i in enumerate(docs):
                starts = windows_of(len(self.ids[i]))
                if worst is None:
                    picks = self.rng.choice(starts, min(4, len(starts)), replace=False)
                else:
                    order = np.argsort(-worst[k][1], kind="stable")[: 2 if self.y[i] else 3]
                    picks = worst[k][0][order] if self.y[i] else np.unique(np.concatenate((worst[k][0][order], self.rng.choice(starts, 1))))
                chosen += [(self.ids[i][s : s + WINDOW], int(self.y[i])) for s in picks]
            order = self.rng.permutation(len(chosen))
            rate = 0.01 * (1 - epoch / (epochs + 1))
            # Few documents still make some dozens of steps in an epoch.
            batch = min(BATCH, max(BATCH_LEAST, len(order) // STEPS))
            for a in range(0, len(order), batch):
                own = [chosen[j] for j in order[a : a + batch]]
                self._batch([w for w, _ in own], np.array([y for _, y in own], float), rate)


def _platt(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of (raw, log windows, 1) by damped Newton steps, with a weak prior."""
    start, prior = np.array([0.5, 0.0, 0.0]), np.array([0.05, 1.0, 0.001])

    def loss(w):
        m = X @ w
        return (np.logaddexp(0, m) - y * m).sum() + 0.5 * (prior * (w - start) ** 2).sum()

    w = start
    for _ in range(100):
        p = _sigmoid(X @ w)
        grad = X.T @ (p - y) + prior * (w - start)
        hess = (X * (p * (1 - p))[:, None]).T @ X + np.diag(prior)
        step, now = np.linalg.solve(hess, grad), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: Sequence[str], y: Sequence[int], rate: float | None = None, epochs: int = EPOCHS) -> Network:
    """A network from labelled whole texts; every fifth document calibrates instead.

    ``rate`` is the share of class 1 among all labelled documents where the
    sample has another: calibration then weighs towards it. Without both
    classes every document scores 0.5 or the share's side of it.
    """
    y = np.asarray(y, int)
    trainer = Trainer(texts, y)
    aside = np.zeros(len(y), bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        if len(own) >= 10:
            aside[own[::5]] = True
    if len(set(y.tolist())) == 2:
        trainer.run(np.flatnonzero(~aside), epochs)
    net = trainer.network()
    fit = np.flatnonzero(aside) if aside.any() and len(set(y[aside].tolist())) == 2 else np.arange(len(y))
    rows = [(logits.max(), np.log(len(starts)), 1.0, y[i]) for i, (starts, logits) in zip(fit, Scorer(net).windows([words_of(texts[i]) for i in fit])) if len(starts)]
    if rows and len({r[3] for r in rows}) == 2:
        X = np.array(rows)
        net.platt = _platt(X[:, :3], X[:, 3])
        if rate is not None and 0 < rate < 1:
            share = y.mean()
            net.platt[2] += np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    else:
        net.platt = np.array([0.0, 0.0, -5.0 if not y.any() else 0.0])
    # Of texts without words their labels alone tell; all texts' share stands for one more of them.
    wordless = y[[not len(i) for i in trainer.ids]] if len(y) else y
    share = rate if rate is not None else float(y.mean()) if len(y) else 0.0
    net.empty = float((wordless.sum() + share) / (len(wordless) + 1))
    return net


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = SAMPLE_DOCS) -> tuple[list[str], list[int], float | None]:
    """Whole texts and labels of at most ``each`` documents a class outside the held-out fold, by hash order of ids, and the share of class 1 among all of them.

    Texts of any length are taken, up to ``SAMPLE_CHARS`` characters in all. An
    id that is labelled both 0 and 1 has no label; NULL texts are empty ones.
    """
    able = one_label(labels, id_col, label_col)
    n = dict(able.groupBy("y").count().collect())
    groups = first_ids(able, each)
    label = {i: y for y, own in groups.items() for i in own}
    rows = sample_rows(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), groups)
    total = sum(n.values())
    return [r[1] or "" for r in rows], [label[r[0]] for r in rows], n.get(1, 0) / total if total else None


FIELDS = [T.StructField("toxicity", T.DoubleType()), T.StructField("worst_word", T.LongType())]


def score(df: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``toxicity`` (probability) and ``worst_word`` (first word of the worst window, -1 for none) for each whole text.

    NULL texts and texts without words score 0 and have no worst word;
    ``net.empty`` tells how likely they are. No shuffle; repeated rows each get
    their result; an empty table gives an empty one; input columns named like an
    output give way to it. Texts of any length are scored whole, in pieces.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)

    def make():
        own = Scorer(shared.value)

        def apply(texts):
            p, worst = own.documents(texts)
            return {"toxicity": p, "worst_word": worst}

        return apply

    return annotate(df, make, FIELDS, text_col, keep)


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_DOCS) -> Network:
    """A network from a bounded sample of the labelled documents outside the held-out fold."""
    texts, y, rate = training_sample(docs, labels, each=each)
    return train(texts, y, rate)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = F.when(F.col("worst_word") < 0, F.lit(net.empty)).otherwise(F.col("toxicity"))
    out = score(docs, net, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("score"), "worst_word")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_word")
