import os

from pyspark.sql import types as T

from framekit.llm import common
from tests.llm.helpers import held_out, none, odd_documents


def test_tables_are_written_and_swept(spark):
    common.sweep(spark)
    a, b = (common.materialize(odd_documents(spark), "t") for _ in (0, 1))
    assert a.count() == odd_documents(spark).count() and a.schema == b.schema
    path = a._framekit_path.removeprefix("file://")
    common.discard(a)
    assert not os.path.exists(path) and common.sweep(spark) == 1
    assert common.materialize(none(spark), "t").count() == 0
    common.discard(none(spark))


def test_shared_dir_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_outputs_win_over_input_columns(spark):
    make = lambda: lambda texts: {"SCORE": [float(len(t or "")) for t in texts]}
    docs = odd_documents(spark)
    out = common.annotate(docs, make, [T.StructField("SCORE", T.DoubleType())])
    assert out.columns == [c for c in docs.columns if c != "Score"] + ["SCORE"]
    assert sorted(r["SCORE"] for r in out.collect()) == sorted(float(len(r["text"] or "")) for r in docs.collect())
    assert common.annotate(docs, make, [T.StructField("SCORE", T.DoubleType())], keep=[]).columns == ["SCORE"]


def test_slices():
    texts = ["x" * 10, None, "", "y" * 500, "z"] * 20
    runs = list(common.slices(texts, 200))
    assert runs[0][0] == 0 and runs[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert list(common.slices([])) == []


def test_one_operators_tables_at_a_time():
    made = []
    assert common.kept("a", lambda: made.append(1) or "A") == "A" and common.kept("a", lambda: made.append(2)) == "A"
    assert common.kept("b", lambda: "B") == "B" and common.kept("a", lambda: "new") == "new" and made == [1]


def test_a_sample_has_room_for_long_texts(spark):
    rows = [(1, "a" * 2_000_000), (2, "b"), (2, "a"), (3, None), (4, "c" * 10), (5, "d")]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    got = common.sample_rows(docs, {0: [1, 2, 3], 1: [4, 5]})
    assert [(r["id"], len(r["text"] or "")) for r in got] == [(1, 2_000_000), (2, 1), (3, 0), (4, 10), (5, 1)] and got[1]["text"] == "a"
    # Where characters run out, the group's first texts stay, whole.
    assert [r["id"] for r in common.sample_rows(docs, {0: [1, 2, 3], 1: [4, 5]}, 20)] == [1, 4]
    assert common.sample_rows(docs, {0: [], 1: []}) == [] and common.sample_rows(docs, {0: [77]}) == []


def test_conflicting_labels_are_none(spark):
    free = [i for i in range(100) if not held_out(i)][:3]
    labels = spark.createDataFrame([(free[0], 0), (free[0], 1), (free[1], 1), (free[1], 1), (free[2], 0), (None, 1), (next(i for i in range(100) if held_out(i)), 1), (free[2], None)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, common.one_label(labels, "doc_id", "toxic").collect())) == [(free[1], 1), (free[2], 0)]
