"""The native operators have no Python in their plans; texts are shuffled once."""

import re

from framekit.llm import mixing, order_minhash
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_native(spark):
    for text in (plan(mixing.op8_mixing(spark, SMALL)), plan(order_minhash.op6_order_minhash(spark, SMALL))):
        assert not re.search("Python|Pandas|Arrow|MapPartitions", text)
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_mixing_carries_rows_through_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    text = plan(mixing.mixed_rows(spark.read.parquet(f"{SMALL}/documents.parquet")))
    # Above the scan of the texts: one exchange by source and range, then the merge and the window.
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "text" in line)
    assert sum("Exchange" in line for line in lines[:scan]) == 1
    window = next(line for line in lines if "Window" in line)
    assert "part#" in window and "range#" in window
