import hashlib
import random

import pytest
from pyspark.sql import functions as F

from framekit.llm import order_minhash as O
from tests.llm.helpers import documents, none, odd_documents, words


def plain_signature(spark, texts):
    """Signatures by plain code over Spark's own hash of each k-mer."""
    grams, places = [], []
    for t in texts:
        ws = words(t)
        own = [ws[i : i + O.WORDS] for i in range(len(ws) - O.WORDS + 1)] or ([[" ".join(ws)]] if ws else [])
        places.append(len(own))
        grams += own
    x64 = lambda rows, schema: [r[0] for r in spark.createDataFrame(rows, schema).select(F.xxhash64("*")).collect()] if rows else []
    hashes = []
    for g in grams:
        hashes.append(tuple(g))
    flat = {}
    for width in {len(g) for g in hashes}:
        distinct = sorted({g for g in hashes if len(g) == width})
        flat |= dict(zip(distinct, x64(distinct, ", ".join(f"c{i} string" for i in range(width)))))
    numbered, at = [], 0
    for n in places:
        seen, out = {}, []
        for i, g in enumerate(hashes[at : at + n]):
            h = flat[g]
            out.append((h, seen.get(h, 0), i))
            seen[h] = seen.get(h, 0) + 1
        at += n
        numbered.append(out)
    pairs = sorted({(h, o) for out in numbered for h, o, _ in out})
    second = dict(zip(pairs, x64(pairs, "a bigint, b int")))
    signs, ask = [], set()
    chosen = []
    for out in numbered:
        bins = {}
        for h, o, i in out:
            g = second[(h, o)] & 0xFFFFFFFF
            bins.setdefault(g >> 26, []).append((g, i))
        chosen.append({b: [g for g, _ in sorted(sorted(v)[:2], key=lambda x: x[1])] for b, v in bins.items()})
        ask |= {tuple(v) for v in chosen[-1].values()}
    digest = {}
    for width in (1, 2):
        own = sorted(k for k in ask if len(k) == width)
        digest |= dict(zip(own, x64(own, ", ".join(f"c{i} bigint" for i in range(width)))))
    for c in chosen:
        signs.append(sorted((b << 26) | ((digest[tuple(v)] & (1 << 64) - 1) >> 38) for b, v in c.items()))
    return signs


def signatures(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", O.signature(F.col("t")).alias("s")).orderBy("i").collect()
    return [sorted(x & 0xFFFFFFFF for x in r["s"]) for r in rows]


def test_against_plain_code(spark):
    rng = random.Random(1)
    texts = ["", " ", "a", "a b", "a b c", "a b c a b c a b c", "x " * 300] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 200))) for _ in range(15)]
    texts += [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(600)) for _ in range(3)]
    assert signatures(spark, texts) == plain_signature(spark, texts)


def test_follows_edit_distance(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    changed = base.copy()
    for i in range(0, 400, 40):
        changed[i] = "new"
    turned = base[200:] + base[:200]
    shuffled = [base[i : i + 10] for i in range(0, 400, 10)]
    rng.shuffle(shuffled)
    shuffled = sum(shuffled, [])
    df = spark.createDataFrame([(" ".join(base), " ".join(x)) for x in (base, changed, turned, shuffled, [f"v{i}" for i in range(400)])], "a string, b string")
    near = [r[0] for r in df.select(O.likeness(O.signature(F.col("a")), O.signature(F.col("b")))).collect()]
    assert near[0] == 1 and near[4] == 0 and near[0] > near[1] > near[3] > near[4] and near[2] < 1


def plain_edits(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out[d] = t[: len(t) - k] + nxt[:k]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_edits(spark, n):
    rng = random.Random(n)
    rows = [(i * 7, rng.choice([None, "", "abc", "é\U0001f600ü", "lorem ipsum " * rng.randint(1, 30)])) for i in range(n)]
    docs = documents(spark, [(d, t, "en", "s", 0) for d, t in rows])
    got = {r["doc_id"]: r for r in O.fingerprint_with_edits(docs).collect()}
    assert {d: r["edited"] for d, r in got.items()} == plain_edits(rows)
    assert {d: r["n_chars"] for d, r in got.items()} == {d: len(t or "") for d, t in rows}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


def test_odd_documents(spark):
    docs = odd_documents(spark)
    out = O.fingerprint_with_edits(docs).collect()
    assert len(out) == docs.count()
    by_text = {}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    for r in out:
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]], set()).add(tuple(r["sign"]))
    assert all(len(s) == 1 for s in by_text.values())
    assert O.fingerprint_with_edits(none(spark)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in O.op6_order_minhash(spark, sf).collect()}
    want = plain_edits(rows)
    assert {d: r["edited_sha256"] for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
    signs = dict(zip([d for d, _ in rows], plain_signature(spark, [t for _, t in rows])))
    edited = dict(zip(list(want), plain_signature(spark, list(want.values()))))
    for d, r in got.items():
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in sorted(signs[d], key=lambda v: v - (1 << 32) if v >> 31 else v)) or sorted(r["fingerprint"][i : i + 8] for i in range(0, len(r["fingerprint"]), 8)) == sorted(f"{x:08x}" for x in signs[d])
        a, b = set(signs[d]), set(edited[d])
        either = len({x >> 26 for x in a} | {x >> 26 for x in b})
        assert r["near_edited"] == pytest.approx(len(a & b) / either if either else 1.0)
