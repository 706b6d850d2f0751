import numpy as np
import pytest

from framekit.llm import toxicity as X
from tests.llm.helpers import by_id, documents, held_out, none, odd_documents

BAD = ["gruntle", "snorkify", "blargmo"]


def corpus(n=400):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abdeiknorst"), 5)) for _ in range(300)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(vocabulary, int(rng.integers(3, 120))))
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(ws) // 25):
                ws[int(rng.integers(len(ws)))] = str(rng.choice(BAD)) + str(rng.choice(["", "s", "ed"]))
        rows.append((i, " ".join(ws), int(bad)))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = [r for r in corpus() if not held_out(r[0])]
    return X.train([r[1] for r in rows], [r[2] for r in rows], 0.25)


def plain_logit(net, words):
    """One window's logit, place by place."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    x = net.inputs(words).astype(float)
    H, states = X.HIDDEN, [np.zeros((len(words), X.HIDDEN)) for _ in (0, 1)]
    for d in (0, 1):
        h = np.zeros(H)
        for t in range(len(words)) if d == 0 else range(len(words) - 1, -1, -1):
            xt, a = x[t, 3 * H * d : 3 * H * (d + 1)], h @ net.U[d]
            z, r = sig(xt[:H] + a[:H]), sig(xt[H : 2 * H] + a[H : 2 * H])
            h = (1 - z) * np.tanh(xt[2 * H :] + r * a[2 * H :]) + z * h
            states[d][t] = h
    s = np.concatenate(states, axis=1)
    e = np.exp(s @ net.v - (s @ net.v).max())
    return float((e / e.sum()) @ s @ net.w + net.b[0])


def test_windows_cover_everything():
    for n in range(0, 200):
        starts = X.windows_of(n)
        covered = {s + i for s in starts for i in range(X.WINDOW) if s + i < n}
        assert covered == set(range(n)) and all(b - a <= X.STRIDE for a, b in zip(starts, starts[1:]))


def test_batched_scores_are_the_plain_ones(net):
    texts = [r[1] for r in corpus(40)] + ["one", None, "", "!!"]
    for text, (starts, logits) in zip(texts, X.Scorer(net).windows([X.words_of(t) for t in texts])):
        ws = X.words_of(text)
        want = [plain_logit(net, ws[s : s + X.WINDOW]) for s in X.windows_of(len(ws))]
        assert np.allclose(logits, want, atol=1e-3) and len(starts) == len(want)


def test_gradients():
    texts, y = ["aa bb cc dd", "ee ff gg hh ii", "aa ee jj"] * 4, np.array([1, 0, 1] * 4)
    t = X.Trainer(texts, y)
    windows = [t.ids[0], t.ids[1]]
    target = np.array([1.0, 0.0])

    def loss():
        net = t.network()
        net.U, net.v, net.w, net.b = [t.p["U0"], t.p["U1"]], t.p["v"], t.p["w"], t.p["b"]
        net.W, net.bias, net.word_vectors, net.char_vectors = t.p["W"], t.p["bias"], t.p["E"], t.p["C"]
        m = np.array([plain_logit(net, [t.words[i] for i in w]) for w in windows])
        return float(np.mean(np.logaddexp(0, m) - target * m))

    grads = {}
    t._adam = lambda k, rows, grad, rate: grads.__setitem__(k, (rows, grad))
    t._batch(windows, target, 0.0)
    rng = np.random.default_rng(0)
    for k in ("U0", "U1", "v", "w", "b", "W", "bias", "C"):
        rows, grad = grads[k]
        full = np.zeros_like(t.p[k])
        full[rows] = grad
        flat = np.flatnonzero(np.abs(full.reshape(-1)) > 1e-4)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            x = t.p[k].reshape(-1)
            old = x[i]
            x[i] = old + 1e-3
            up = loss()
            x[i] = old - 1e-3
            down = loss()
            x[i] = old
            assert (up - down) / 2e-3 == pytest.approx(full.reshape(-1)[i], rel=0.05, abs=2e-4), k


def test_held_out_accuracy(net):
    rows = [r for r in corpus() if held_out(r[0])]
    p, worst = X.Scorer(net).documents([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    assert ((p >= 0.5) == y).mean() > 0.9
    for r, w in zip(rows, worst):
        if r[2] and p[rows.index(r)] > 0.9:
            assert any(x.startswith(tuple(BAD)) for x in X.words_of(r[1])[w : w + X.WINDOW])


def test_odd_documents(spark, net):
    docs = odd_documents(spark)
    out = X.score(docs, net)
    assert out.count() == docs.count() and "Score" in out.columns
    got = by_id(out, "toxicity", "worst_word")
    assert got[2] == got[3] == got[4] == (0.0, -1) and all(0 <= v[0] <= 1 for v in got.values())
    assert X.score(none(spark), net).count() == 0


def test_few_or_no_labels(spark):
    for texts, y in (([], []), (["a b c"], [1]), (["a b", "c d"], [0, 0]), (["", ""], [0, 1])):
        net = X.train(texts, y)
        p, _ = X.Scorer(net).documents(["a b c", None])
        assert np.isfinite(p).all() and p[1] == 0


def test_sample_leaves_the_fold_out(spark):
    rows = corpus(120)
    docs = documents(spark, [(r[0], r[1], "en", "s", 0) for r in rows] + [(None, "x", "en", "s", 0)])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(rows[0][0], rows[0][2]), (None, 1), (5, None)], "doc_id bigint, toxic int")
    texts, y, rate = X.training_sample(docs, labels, each=15)
    held = {r[1] for r in rows if held_out(r[0])}
    assert not held & set(texts) and y.count(1) == 15 and y.count(0) == 15 and 0.2 < rate < 0.3


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = X.op3_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held_out(r["doc_id"]) for r in got)


def test_long_documents_are_scored_in_pieces(net):
    words = [str(w) for w in np.random.default_rng(7).choice(["aa", "bb", "cc", *BAD], 5000, p=[0.33, 0.33, 0.33, 0.01 / 3, 0.01 / 3, 0.01 / 3])]
    (starts, logits), (again, parts) = X.Scorer(net).windows([words])[0], X.Scorer(net).windows([words], 700)[0]
    assert np.array_equal(starts, again) and np.allclose(logits, parts, atol=1e-5)


def test_training_takes_texts_of_any_length(spark):
    rows = corpus(150)
    long = " ".join(["abdei", "knors"] * 170_000)
    free = [r[0] for r in rows if not held_out(r[0]) and not r[2]][0]
    docs = documents(spark, [(r[0], long if r[0] == free else r[1], "en", "s", 0) for r in rows])
    texts, y, _ = X.training_sample(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    assert len(long) > 2_000_000 and long in texts and y[texts.index(long)] == 0


def test_texts_without_words_take_the_share_of_their_labels():
    rows = [r for r in corpus(200) if not held_out(r[0])]
    some = X.train([r[1] for r in rows] + ["", "!"] * 10, [r[2] for r in rows] + [1] * 20, 0.25, epochs=1)
    none_ = X.train([r[1] for r in rows], [r[2] for r in rows], 0.25, epochs=1)
    assert some.empty > 0.9 and none_.empty == 0.25
