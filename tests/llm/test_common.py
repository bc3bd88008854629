import random
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm import common


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(0)
    yield [(i, i + 1) for i in range(120)]  # a chain
    yield [(500 - i, 499 - i) for i in range(90)]
    yield [(7, i) for i in range(100, 300)]  # a star
    yield [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(None, 3), (4, None), (5, 5), (1, 2), (1, 2), (2, 1)]
    yield []


@pytest.mark.parametrize("edges", list(graphs()), ids=["chain", "back", "star", "random", "empty"])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in common.components(df).collect()} == brute(edges)


def test_word_count(spark):
    texts = [None, "", " ", "a", " a  b\tc\n", "\x0b\x0c", "é 漢字 x", "x" * 100_000 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.word_count(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == {t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts}


def test_checkpoints_go_to_the_folder_that_the_session_names(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    df = common.materialize(spark.range(10))
    assert df.count() == 10 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert folder.isEmpty() or spark.sparkContext._jsc.sc().getCheckpointDir().get() == folder.get()
