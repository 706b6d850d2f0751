import random
from collections import defaultdict

import pytest
import xxhash

from framekit.llm import simhash
from framekit.llm.components import components
from tests.llm.helpers import documents, none, odd_documents


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(rows):
    """Component ids by comparing all pairs of fingerprints."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, fp in rows:
        least[find(fp)].append(d)
    return sorted((d, fp, min((x for x in least[find(fp)] if x is not None), default=None)) for d, fp in rows if d is not None)


def unsigned(x):
    return x & (1 << 64) - 1


@pytest.mark.parametrize("text", [None, "", "one", "one two", "A b C", "x " * 5000, "a\x0bb\x1cc d e f g", "Ä ä Ö word"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 64)
    assert simhash.fingerprint(text) == want == plain_fingerprint(text)


def test_links_reach_all_pairs(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):
            for _ in range(rng.choice((1, 2))):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    stars = {unsigned(r[0]): unsigned(r[1]) for r in components(simhash.links(df)).collect()}
    got = defaultdict(set)
    for x in fps:
        got[stars.get(x, x)].add(x)
    want = defaultdict(set)
    for i, (_, fp, c) in enumerate(plain_classes([(k, x) for k, x in enumerate(sorted(fps))])):
        want[c].add(fp)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values()}
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(50)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100 and all(got[200 + i] == 200 for i in range(1, 50)) and 7 in got
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    assert sorted((r[0], unsigned(r[1]), r[2]) for r in got if r[0] is not None) == plain_classes(rows)
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_one_of_each_class(spark):
    kept = simhash.drop_near_duplicates(odd_documents(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 8 not in ids and 3 not in ids and 1 in ids and 2 in ids and kept.columns[5] == "fp"
    assert sum(i is None for i in ids) == 1
    alone = documents(spark, [(None, "same words here", "en", "a", 1)] * 3 + [(None, "other words there", "en", "a", 1)])
    assert simhash.drop_near_duplicates(alone).count() == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op5_simhash(spark, sf).collect())
    assert got == plain_classes(rows)
