import numpy as np
import pyarrow as pa
import pytest

from framekit.llm import permutation_index as I


def plain(rows, step, k):
    """Nearest neighbours by brute force over usable vectors."""
    dims = [len(v) for _, v in rows if v]
    dim = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v) and len(v) == dim]
    out = {}
    for q, v in ok:
        if q % step == 0:
            near = sorted(((-float((v * w).sum()), i) for i, w in ok if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, `rank` string")


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_footrule():
    rng = np.random.default_rng(0)
    orders = np.array([rng.permutation(12)[:5] for _ in range(40)], np.uint8)
    files = I.InvertedFiles(orders, 12)
    for q in orders[:10]:
        want = [sum(abs(list(o).index(p) - i) if p in o else 5 - i for i, p in enumerate(q)) for o in orders]
        assert np.allclose(files.footrule(q), want)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60, None), (80, [0.0] * 8), (100, [float("nan")] + [1.0] * 7), (120, [None] + [1.0] * 7), (140, [float("inf")] * 8), (160, []), (180, [1.0, 2.0]), (None, [1.0] * 8)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, [float(np.float32(x * 100)) for x in rows[6][1]])]
    got, want = found(I.nearest(frame(spark, rows))), plain(rows, 20, 20)
    assert set(got) == set(want)
    for q in want:
        assert [x[0] for x in got[q]] == [x[0] for x in want[q]] and np.allclose([x[1] for x in got[q]], [x[1] for x in want[q]], rtol=1e-12)
    few = frame(spark, rows[:3])
    assert len(found(I.nearest(few))[0]) == 2
    assert I.nearest(frame(spark, [])).count() == 0 and I.nearest(frame(spark, [(0, [0.0])])).count() == 0
    assert I.nearest(frame(spark, [(0, [1.0])])).count() == 0


def test_repeated_rows(spark):
    v = [1.0, 0.5]
    got = found(I.nearest(frame(spark, [(0, v), (0, v), (1, v), (1, v), (2, [0.5, 1.0])])))
    assert [x[0] for x in got[0]] == [1, 1, 2]


@pytest.mark.parametrize("lengths", [False, True])
def test_recall(spark, monkeypatch, lengths):
    monkeypatch.setattr(I, "RERANK_LEAST", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths:
        x *= rng.uniform(0.5, 2, size=(3000, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = found(I.nearest(frame(spark, rows), 60)), plain(rows, 60, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9, recall


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(I.op10_ann(spark, sf)), plain(rows, 20, 20)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_recall_of_the_production_setting(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50000, 64)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.reshape(-1), 64).cast(pa.list_(pa.float32()))}))
    got = found(I.nearest(df, 500))
    y = x.astype(float)
    hits = []
    for q in range(0, len(y), 500):
        near = y @ y[q]
        near[q] = -np.inf
        hits.append(len({i for i, _ in got[q]} & set(np.argsort(-near)[:20].tolist())) / 20)
    assert len(got) == 100 and np.mean(hits) >= 0.97, np.mean(hits)
    print(f"recall {np.mean(hits):.4f}")


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, scale):
    sf = f"/root/testdata/{scale}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    assert I.reranked(len(rows)) < 0.4 * len(rows)
    got, hits = found(I.op10_ann(spark, sf)), []
    for q in got:
        near = x @ x[ids == q][0]
        near[ids == q] = -np.inf
        hits.append(len({i for i, _ in got[q]} & set(ids[np.lexsort((ids, -near))[:20]].tolist())) / 20)
    assert len(got) == sum(ids % 20 == 0) and np.mean(hits) >= 0.97, np.mean(hits)


def test_clustered_vectors_visit_few_shards(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.02 * rng.normal(size=(6000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = I.build_index(frame(spark, rows))
    shards = {s for own in index.shards for s in own}
    asked = index.rows.where("id % 300 = 0").select("id", "vector")
    plan = I.search(index, asked)
    got, want = found(plan), plain(rows, 300, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    codes = I.coded(I.orders(x[::300].astype(float), index.points, index.longest, query=True), len(index.points), I.STEPS)
    sampled = I.InvertedFiles(None, len(index.points), I.STEPS, index.sample)
    share = I.reranked(len(x)) / len(x)
    visits = []
    for c in codes:
        limit = np.sort(sampled.differing(c))[int(np.ceil(share * len(index.sample))) - 1]
        near = np.flatnonzero((index.radius >= 0) & (np.bitwise_count(index.centres ^ c).sum(axis=1) - index.radius <= limit))
        visits.append(len({s for f in near for s in index.shards[f]}))
    assert len(shards) >= 12 and np.mean(visits) < 0.6 * len(shards), (np.mean(visits), len(shards))


def test_large_files_are_several_parts():
    shards = I._packed({0: 5, 1: 30, 3: 4, 4: 4}, 10)
    assert shards == [[0], [1, 2, 3], [], [4], [4]]
