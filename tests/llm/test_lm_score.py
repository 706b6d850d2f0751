import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framekit.llm import lm_score as L
from tests.llm.helpers import documents, held_out, none, odd_documents


def corpus(n=60):
    good, other = "the cat sat on the mat with a good hat".split(), "buy cheap pills now at our best site".split()
    return [(i, " ".join((good if i % 2 else other)[(i + j) % 9 % 8] for j in range(5 + i % 20)), i % 2) for i in range(n)]


def plain_scores(rows, targets, top, classes):
    """Losses under both models, token by token."""
    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    n = Counter(w for _, t, _ in rows for w in tok(t))
    vocabulary = [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))][:top]
    number = lambda w: vocabulary.index(w) + 1 if w in vocabulary else len(vocabulary) + 1 + zlib.crc32(w[-3:].encode()) % classes
    size = 1 + len(vocabulary) + classes
    counts = [Counter(), Counter()]
    for d, t, _ in rows:
        ids = [0] + [number(w) for w in tok(t)]
        for pair in zip(ids, ids[1:]):
            counts[0][pair] += 1
            if d in targets:
                counts[1][pair] += 1
    scale = sum(counts[1].values()) / sum(counts[0].values())
    background = {k: v * scale for k, v in counts[0].items()}

    def model(c):
        one, before = Counter(), Counter()
        for (a, b), v in c.items():
            one[b] += v
            before[a] += v
        total = sum(one.values())
        p1 = lambda b: (one[b] + L.SMOOTHING / size) / (total + L.SMOOTHING)
        return lambda a, b: math.log((c.get((a, b), 0) + L.SMOOTHING * p1(b)) / (before[a] + L.SMOOTHING))

    t_model, b_model = model(counts[1]), model(background)
    out = {}
    for d, t, _ in rows:
        ids = [0] + [number(w) for w in tok(t)]
        pairs = list(zip(ids, ids[1:]))
        out[d] = (len(pairs), -sum(t_model(*p) for p in pairs) / len(pairs), -sum(b_model(*p) for p in pairs) / len(pairs)) if pairs else (0, 0, 0)
    return out


def test_against_plain_code(spark, monkeypatch):
    monkeypatch.setattr(L, "VOCABULARY", 9)
    monkeypatch.setattr(L, "FLUSH", 3)
    rows = corpus()
    docs = documents(spark, [(d, t, "en", "s", 0) for d, t, _ in rows])
    targets = {d for d, _, q in rows if q and not held_out(d)}
    ids = spark.createDataFrame([(d,) for d in targets] + [(3,), (None,)], "id bigint")
    targets.add(3)
    models = L.fit(L.flag_targets(docs, ids))
    got = {r["doc_id"]: r for r in L.score(docs, models, keep=["doc_id"]).collect()}
    for d, (n, t, b) in plain_scores(rows, targets, 9, L.CLASSES).items():
        r = got[d]
        assert r["n_tokens"] == n and r["target_loss"] == pytest.approx(t, abs=1e-5) and r["background_loss"] == pytest.approx(b, abs=1e-5)
        assert r["lm_score"] == pytest.approx(b - t, abs=1e-5)
    assert min(got[d]["lm_score"] for d, _, q in rows if q) > max(got[d]["lm_score"] for d, _, q in rows if not q)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    flagged = L.flag_targets(docs, spark.createDataFrame([(1,), (6,)], "id bigint"))
    assert flagged.count() == docs.count() and flagged.where("is_target").count() == 3
    models = L.fit(flagged)
    out = L.score(docs, models)
    assert out.count() == docs.count()
    got = {r["doc_id"]: (r["n_tokens"], r["lm_score"]) for r in out.collect()}
    assert got[2] == got[3] == got[4] == (0, 0.0) and all(math.isfinite(v[1]) for v in got.values())
    empty = L.fit(L.flag_targets(none(spark), spark.createDataFrame([], "id bigint")))
    assert L.score(none(spark), empty).count() == 0
    assert all(math.isfinite(r["lm_score"]) for r in L.score(docs, empty).collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert L.op2_lm_score(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def rare_corpus(n=300):
    rng = np.random.default_rng(8)
    names = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(4000)]
    return [(i, " ".join("the" if rng.random() < 0.3 else str(rng.choice(names)) for _ in range(int(rng.integers(0, 60)))), int(i % 3 == 0)) for i in range(n)]


def plain_scores_open(rows, targets):
    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    pairs = [Counter(), Counter()]
    for d, t, _ in rows:
        for pair in zip([None, *tok(t)], tok(t)):
            pairs[0][pair] += 1
            pairs[1][pair] += d in targets
    size, out = 1 + len({b for _, b in pairs[0]}), {}
    scale = sum(pairs[1].values()) / sum(pairs[0].values())
    models = []
    for c in ({k: v * scale for k, v in pairs[0].items()}, dict(pairs[1])):
        one, before = Counter(), Counter()
        for (a, b), v in c.items():
            one[b] += v
            before[a] += v
        models.append((c, one, before, sum(one.values())))
    for d, t, _ in rows:
        ws, loss = tok(t), []
        for c, one, before, total in models:
            p1 = lambda b: (one[b] + L.SMOOTHING / size) / (total + L.SMOOTHING)
            loss.append(-sum(math.log((c.get((a, b), 0) + L.SMOOTHING * p1(b)) / (before[a] + L.SMOOTHING)) for a, b in zip([None, *ws], ws)) / max(1, len(ws)))
        out[d] = (len(ws), loss[1], loss[0])
    return out


@pytest.mark.parametrize("small", [False, True])
def test_open_vocabulary_against_plain_code(spark, monkeypatch, small):
    if small:
        # Many parts, several tasks for each, merging in rounds.
        for name, value in (("PART_CHARS", 500), ("PART_TOKENS", 100), ("FAN_IN", 2)):
            monkeypatch.setattr(L, name, value)
        monkeypatch.setattr(L, "slices", lambda texts: [(i, min(i + 7, len(texts))) for i in range(0, len(texts), 7)])
    rows = rare_corpus()
    docs = documents(spark, [(d, t, "en", "s", 0) for d, t, _ in rows]).repartition(3)
    targets = {d for d, _, q in rows if q}
    models = L.fit(L.flag_targets(docs, spark.createDataFrame([(d,) for d in targets], "id bigint")))
    assert models.vocabulary is None and (models.parts > 20 and max(models.spread) > 1) == small
    got = {r["doc_id"]: r for r in L.score(docs, models, keep=["doc_id"]).collect()}
    assert len(got) == len(rows)
    for d, (n, t, b) in plain_scores_open(rows, targets).items():
        r = got[d]
        assert (r["n_tokens"], r["target_loss"], r["background_loss"]) == (n, pytest.approx(t, abs=1e-4), pytest.approx(b, abs=1e-4))


def test_words_that_the_corpus_lacks(spark):
    rows = rare_corpus(40)
    docs = documents(spark, [(d, t, "en", "s", 0) for d, t, _ in rows])
    models = L.fit(L.flag_targets(docs, spark.createDataFrame([(3,)], "id bigint")))
    other = documents(spark, [(1, "entirely unseen words", "en", "s", 0), (1, rows[3][1], "en", "s", 0)])
    got = L.score(other, models, keep=["doc_id", "text"]).collect()
    losses = {r["text"]: r["target_loss"] for r in got}
    assert len(got) == 2 and losses["entirely unseen words"] > losses[rows[3][1]]


def test_ids_beyond_the_broadcast_are_merged(spark, monkeypatch):
    docs = odd_documents(spark)
    ids = spark.createDataFrame([(1,), (6,), (None,)], "id bigint")
    key = lambda r: (r["text"] or "", r["is_target"])
    want = sorted(L.flag_targets(docs, ids).collect(), key=key)
    monkeypatch.setattr(L, "BROADCAST_IDS", 1)
    merged = L.flag_targets(docs, ids)
    assert sorted(merged.collect(), key=key) == want and "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()


def test_a_very_long_text(spark):
    long = "alpha beta " * 200_000
    docs = documents(spark, [(1, long, "en", "s", 0), (2, "alpha beta", "en", "s", 0)])
    models = L.fit(L.flag_targets(docs, spark.createDataFrame([(2,)], "id bigint")))
    got = {r["doc_id"]: r["n_tokens"] for r in L.score(docs, models, keep=["doc_id"]).collect()}
    assert got == {1: 400_000, 2: 2}
