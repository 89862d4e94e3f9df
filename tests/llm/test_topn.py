"""The N best items of every group, against a plain sort."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from depweave.llm.topn import latest, top_n


def test_top_n_brute_force(spark, rows):
    rng = random.Random(5)
    data = [(rng.choice(["r", "s", None]), rng.choice("abc" * 5 + "d"), rng.choice([f"t{j}" for j in range(60)] + [None, "é", "Z"]), rng.choice([None, -(2**63), 2**63 - 1, *range(6)]), i) for i in range(4000)]
    data += data[:50]
    df = spark.createDataFrame(data, "g string, f string, t string, s long, i int").repartition(5)
    got = rows(top_n(df, ["g", "f"], "s", "t", 5), "g", "f", "rank", "t", "s")
    groups = defaultdict(list)
    for g, f, t, s, _ in data:
        if s is not None:
            groups[(g, f)].append((-s, t is not None, (t or "").encode(), t, s))
    want = [(g, f, k + 1, x[3], x[4]) for (g, f), v in groups.items() for k, x in enumerate(sorted(v)[:5])]
    assert got == sorted(want, key=repr)
    with pytest.raises(ValueError):
        top_n(df, ["g"], "s", "t", 0)
    assert top_n(df.limit(0), ["g"], "s", "t", 5).count() == 0


def test_latest_decides_ties(spark, rows):
    df = spark.createDataFrame([("a", 1, 5, 9), ("a", 2, 1, None), ("a", 2, 1, 4), ("b", None, 1, 1), ("b", 0, 0, 7), (None, 1, 1, 1)], "k string, t int, i int, v int")
    assert rows(latest(df, ["k"], ["t", "i"], ["v"])) == [("a", 4), ("b", 7), (None, 1)]


def test_top_n_keeps_clashing_names_apart(spark, rows):
    df = spark.createDataFrame([("g", "a", 3, 1), ("g", "b", 3, 2)], "rank string, p_ string, s long, heap_ int")
    got = top_n(df, ["rank"], "s", "p_", 1)
    assert got.columns == ["rank", "p_", "s", "rank_"] and rows(got) == [("g", "a", 3, 1)]


def test_no_group_is_gathered(spark):
    """Heaps are built before the exchange and merged after it; nothing is collected or sorted by group."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("s"), F.col("id").cast("string").alias("t"))
    plan = top_n(df, ["g"], "s", "t", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") == 2 and "partial_collect_top_k" in plan and "Window" not in plan and "collect_list" not in plan
