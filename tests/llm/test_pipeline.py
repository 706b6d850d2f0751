from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as pipeline
from framekit.llm import bpe, langid, mixing, simhash, toxicity
from tests.llm.helpers import by_id, documents, none, odd_documents

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        out = stage(spark, docs, SF).cache()
        if name != "bpe":
            assert out.columns == columns
        if name in ("toxicity", "language", "near_duplicates"):
            assert out.count() <= before
            assert out.exceptAll(docs).count() == 0
        docs = out


def test_toxic_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = toxicity.fit(docs, labels)
    want = {r["doc_id"] for r in toxicity.score(docs, net, keep=["doc_id"]).collect() if r["toxicity"] < 0.7}
    got = {r["doc_id"] for r in pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    assert got == want
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(clean & got) >= 0.97 * len(clean)


def test_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert pipeline.keep_languages(spark, docs, SF).count() >= 0.97 * docs.count()
    junk = documents(spark, [(900001, "123 456 !!", "en", "s", 0), (900002, None, "en", "s", 0)]).unionByName(docs)
    kept = {r[0] for r in pipeline.keep_languages(spark, junk, SF).select("doc_id").collect()}
    assert not {900001, 900002} & kept
    assert langid.UNKNOWN == "und"


def test_copies_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = Counter(r[0] for r in pipeline.drop_copies(spark, docs, SF).select("doc_id").collect())
    want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert set(kept) == want and max(kept.values()) == 1


def test_mix_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter(r[0] for r in pipeline.mix_sources(spark, docs, SF).select("doc_id").collect())
    want = {i: t // s for i, (s, t) in by_id(mixing.mix(docs, unit="document"), "size", "taken").items() if s and t}
    assert got == want


def test_run(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pipeline.run(spark, SF).collect()
    assert rows
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text[r["doc_id"]])


def test_odd_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 0), (5, 0), (6, 1), (8, 0), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{sf}/labels.parquet")
    for docs in (odd_documents(spark), none(spark)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "bpe" or out.columns == docs.columns
            out.count()


def test_mixtures_of_languages_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 400 and 3000 and lang is not null")
    one = {}
    for r in sorted(langid.identify(docs, langid.fit(docs)).where("lang_score > 0.98").collect(), key=lambda r: r["doc_id"]):
        one.setdefault(r["lang_pred"], r["text"].split())
    parts = [one[x] for x in sorted(one)[:3]]
    n = min(map(len, parts)) // 4
    mixed = " ".join(" ".join(p[: n * k]) for p, k in zip(parts, (4, 3, 3)))
    more = documents(spark, [(900001, mixed, None, "s", len(mixed))]).unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    found = langid.identify(more, langid.fit(more)).where("doc_id = 900001").first()
    assert found["lang_score"] < 0.5 and len(found["lang_mix"]) == 3
    assert pipeline.keep_languages(spark, more, SF).where("doc_id = 900001").count() == 1
