import pytest

from framekit.llm import mixing
from framekit.llm.queries import ORACLE_SQL
from tests.llm.helpers import documents, none, odd_documents, words


def plain_targets(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_word_count(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " ", "a", " a", "a ", "a b", "\ta\x0b\x0cb\n", "a\x1cb c d", "  x  y  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [len(words(t)) for t in texts]


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 2, "d": 5}, {None: 50, "z": 1}, {"a": 0, "b": 10}, {"a": 7}, {f"s{i:02d}": (i * 37) % 91 for i in range(20)}],
)
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    want = plain_targets(sizes)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark, monkeypatch):
    rows = [(i, "w " * (i % 17), "en", f"s{i % 5}" if i % 3 else "hot", 0) for i in range(600)]
    docs = documents(spark, rows)
    first = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    again = {r["doc_id"]: r for r in mixing.mix(docs.repartition(3)).collect()}
    assert first == again and len(first) == 600
    source = {r[0]: r[3] for r in rows}
    for s in set(source.values()):
        own = [r for i, r in first.items() if source[i] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in first.values())


def test_rows_of_the_mix(spark):
    rows = [(i, "w " * (1 + i % 17), "en", f"s{i % 4}", 0) for i in range(400)]
    docs = documents(spark, rows)
    out = mixing.mixed_rows(docs).collect()
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs, unit="document").collect()}
    times = {}
    for r in out:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: n for i, n in taken.items() if n}


def test_odd_documents(spark):
    docs = odd_documents(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    assert sorted(r["size"] for r in out) == sorted(len(words(r["text"])) for r in docs.collect())
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(none(spark)).count() == 0 and mixing.mixed_rows(none(spark)).count() == 0
    empty = documents(spark, [(1, "", "en", "a", 0), (2, None, "en", "a", 0)])
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


def test_sql(spark):
    from tests.oracle_check import connect, differ

    sf = "/root/testdata/sf0.001"
    assert differ(mixing.op8_mixing(spark, sf), connect(sf), ORACLE_SQL["op8_mixing"]) == ""


def test_rows_without_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    rows = [(None, "w " * (i % 91), "en", "hot", 0) for i in range(900)] + [(i, "w " * (i % 7), "en", "hot", 0) for i in range(300)] + [(i, "w", "en", "z", 0) for i in range(500, 800)]
    docs = documents(spark, rows)
    out = mixing.mix(docs)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "tie#" in next(line for line in text.splitlines() if "Window" in line and "part#" in line and "range#" in line)
    got = out.collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len(words(r[1])) for r in rows)
    for total in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == total]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
    # By size, the first rows in order: what is taken in part is taken from the smaller ones.
    nameless = sorted((r["size"], r["taken"]) for r in got if r["doc_id"] is None)
    times = [t / s for s, t in nameless if s]
    assert times == sorted(times, reverse=True)
