import math
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from framekit.llm import cotrain as C
from tests.llm.helpers import by_id, documents, held_out, none, odd_documents


def corpus(n=500):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        ws = ["".join(rng.choice(list("aeinorst"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(5, 60)))]
        text = " ".join(ws) if good else " ".join(w + "!!!" if rng.random() < 0.6 else w for w in ws)
        rows.append((i, text, "en", f"{'good' if good else 'bad'}{rng.integers(3)}" if rng.random() < 0.9 else "any", len(text), int(good)))
    return rows


def split(rows):
    own = [r for r in rows if not held_out(r[0])]
    return own[:60], own[60:]


def test_held_out_accuracy_and_exchange(monkeypatch):
    rows = corpus()
    few, more = split(rows)
    meta = lambda r: (r[2], r[3], r[4])
    model = C.train([r[1] for r in few], [meta(r) for r in few], [r[5] for r in few], [r[1] for r in more], [meta(r) for r in more])
    held = [r for r in rows if held_out(r[0])]
    text, about = np.array([C.text_features(r[1]) for r in held]), np.array([C.meta_features(meta(r)) for r in held])
    y = np.array([r[5] for r in held])
    assert ((model.probability(text, about) >= 0.5) == y).mean() > 0.93
    alone = C.train([r[1] for r in few], [meta(r) for r in few], [r[5] for r in few], [], [])
    view = lambda m: ((m.logits(1, about) > 0) == y).mean()
    assert view(model) >= view(alone) - 0.02
    assert not np.allclose(model.views[1], alone.views[1])


def test_few_or_no_labels():
    for texts, y in (([], []), (["a"], [1]), (["a", "b"], [0, 0]), (["good one", ""], [1, 0])):
        m = C.train(texts, [("en", None, 1)] * len(texts), y, ["x"], [(None, None, None)])
        p = m.probability(np.array([C.text_features(None)]), np.array([C.meta_features((None, "s", 3))]))
        assert np.isfinite(p).all()


def test_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = C.fit(docs, labels)
    out = C.score(docs, model)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert all(0 <= r["quality_score"] <= 1 for r in out.collect())
    same = [r["quality_score"] for r in out.where("doc_id = 6").collect()]
    assert len(same) == 2 and same[0] == same[1]
    assert C.score(none(spark), model).count() == 0
    clash = docs.withColumnRenamed("size", "Quality_Score")
    assert "quality_score" in C.score(clash, model).columns


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = by_id(C.op7_cotrain(spark, sf), "score", "predicted", "held_out")
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held_out(r["doc_id"])]
    assert np.mean([got[r["doc_id"]][1] == r["quality"] for r in labels]) > 0.85
    assert documents(spark, []).count() == 0


def test_every_sure_document_is_handed_over(spark):
    rows = corpus(4000)
    labels = [(r[0], r[5]) for r in split(rows)[0]]
    docs = documents(spark, [r[:5] for r in rows])
    # The documents that come last in the order that the pool of 2,500 was taken in.
    late = {r[0] for r in docs.orderBy(F.xxhash64(F.lit(7), "doc_id").desc()).limit(1000).collect()} - {i for i, _ in labels}
    others = sum(C.meta_features(r[2:5]) for r in rows)
    name = next(n for n in (f"rare{k}" for k in range(1000)) if not others[crc32(f"1={n}".encode()) % C.META])
    rows = [(*r[:3], name, *r[4:]) if r[0] in late and r[5] else r for r in rows]
    docs = documents(spark, [r[:5] for r in rows])
    model = C.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert model.views[1][crc32(f"1={name}".encode()) % C.META] > 0
    # Spread over tasks, the sums are those of all unlabelled rows in one place.
    known = {i for i, _ in labels}
    rest = [r for r in rows if r[0] not in known]
    got = C._gather(docs.selectExpr("doc_id id", "text", "lang m0", "source m1", "n_chars m2"), known, 3)(model)
    assert np.allclose(got, C._sums(model, [r[1] for r in rest], [r[2:5] for r in rest]))
    assert got[0] > 5 * 60


def test_mean_word_length_takes_every_word():
    words = ["a", "b", "cdef"] * 400
    assert np.isclose(C.text_features(" ".join(words))[-2], 2 / 20)


def plain_features(text, meta):
    """Both views' features, counted one by one."""
    data = (text or "").encode()
    pairs = Counter((a * 2654435 + b * 40503) % 2**32 % C.BIGRAMS for a, b in zip(data, data[1:]))
    named = [f"{i}=~{round(math.log2(1 + v))}" if isinstance(v, int) else f"{i}={v}" for i, v in enumerate(meta)]
    named += [a + "&" + b for i, a in enumerate(named) for b in named[i + 1 :]]
    return [4 * math.sqrt(pairs[k] / max(1, len(data) - 1)) for k in range(C.BIGRAMS)], Counter(crc32(p.encode()) % C.META for p in named)


def test_packed_features_are_the_plain_ones():
    long = "ab" * 1_000_000
    rows = [("The cat. sat", ("en", "a", 12)), ("", ("en", None, 0)), (None, (None, None, None)), ("x", ("de", "b", 1)), ("é" * 400, ("fr", "c", 400)), (long, ("en", "a", len(long)))]
    text, meta = C.unpack([C.pack(*r) for r in rows])
    for i, (t, m) in enumerate(rows):
        assert np.allclose(text[i], C.text_features(t)) and np.allclose(meta[i], C.meta_features(m))
        pairs, named = plain_features(t, m)
        assert np.allclose(text[i][: C.BIGRAMS], pairs) and all(meta[i][k] == named[k] for k in range(C.META))


def plain_fit(X, y, weight, w, rounds, more=None):
    """Adam on the logistic loss, row by row, with the handed-over rows' sums as a bound."""
    w, start = list(w), list(w)
    m, v = [0.0] * len(w), [0.0] * len(w)
    extra, slope, bend = more or (0.0, [0.0] * len(w), [0.0] * len(w))
    total = sum(weight) + extra
    for k in range(1, rounds + 1):
        g = [1e-3 * a for a in w]
        for row, target, u in zip(X, y, weight):
            row = [*row, 1.0]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, row))))
            g = [a + u * (p - target) * b / total for a, b in zip(g, row)]
        g = [a + (s + c * (x - x0)) / total for a, s, c, x, x0 in zip(g, slope, bend, w, start)]
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g)]
        v = [0.99 * a + 0.01 * b * b for a, b in zip(v, g)]
        w = [x - 0.05 * (a / (1 - 0.9**k)) / (math.sqrt(b / (1 - 0.99**k)) + 1e-9) for x, a, b in zip(w, m, v)]
    return w


def test_a_round_of_exchange_is_the_plain_one():
    rng = np.random.default_rng(4)
    X, y = rng.normal(size=(12, 5)), rng.integers(0, 2, 12).astype(float)
    weight = rng.uniform(0.5, 2, 12)
    first = C.fit_logistic(X, y, weight, rounds=20)
    assert np.allclose(first, plain_fit(X, y, weight, [0.0] * 6, 20))
    # What the second view's sure documents tell the first one, row by row.
    text, meta = rng.normal(size=(40, 5)), rng.normal(size=(40, 3))
    model = C.CoTrained([np.zeros(5), np.zeros(3)], [first, np.array([2.0, -3.0, 1.0, 0.1])], np.zeros(3))
    want = [[0.0] * 13, [0.0] * 13]
    for t, m in zip(text, meta):
        z = float(m @ model.views[1][:-1] + model.views[1][-1])
        p = 1 / (1 + math.exp(-z))
        for c, sure in ((0, p <= 1 - C.SURE), (1, p >= C.SURE)):
            if sure:
                row = [*t, 1.0]
                q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(first, row))))
                one = [1.0] + [(q - c) * a for a in row] + [abs(a) * sum(map(abs, row)) / 4 for a in row]
                want[c] = [a + b for a, b in zip(want[c], one)]
    sums = C.handed_over(model, text, meta)
    assert np.allclose(sums[:26], want[0] + want[1]) and want[0][0] and want[1][0]
    more = C._learn_from(sums, 0, 6, weight.sum())
    own = [min(C.HANDED, C.HANDED_MOST / 2 * weight.sum() / max(n[0], 1)) for n in want]
    plain = (sum(u * n[0] for u, n in zip(own, want)), *[[sum(u * n[k + j] for u, n in zip(own, want)) for j in range(6)] for k in (1, 7)])
    assert np.allclose(C.fit_logistic(X, y, weight, first, 15, more=more), plain_fit(X, y, weight, first, 15, plain))


def test_nothing_is_learned_from_the_held_out_fold(spark):
    rows = corpus(600)
    labels = spark.createDataFrame([(r[0], r[5]) for r in split(rows)[0]], "doc_id bigint, quality int")
    other = [(r[0], "9!" * 50, "xx", "other", 7) if held_out(r[0]) else r[:5] for r in rows]
    a, b = C.fit(documents(spark, [r[:5] for r in rows]), labels), C.fit(documents(spark, other), labels)
    assert all(np.allclose(x, y) for x, y in zip([*a.views, a.blend], [*b.views, b.blend]))
