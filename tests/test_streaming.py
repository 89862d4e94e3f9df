"""Arriving edges: a re-check per batch, windows, and the result cache."""

import uuid

import pytest
from pyspark.sql import functions as F

from depweave.operators.graph import Graph
from depweave.plans import rules as ru
from depweave.streaming import edges as st


def test_watch_judges_each_batch(spark, tmp_path, rows):
    src = tmp_path / "in"
    df = spark.createDataFrame([("a/x", 0, "b/y"), ("a/x", 1, "c/z"), ("a/x", 0, "b/y")], "source string, ord long, resolved string")
    df.coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema(df.schema).parquet(str(src))
    rs = ru.load({"forbidden": [{"name": "r", "severity": "error", "from": {"path": "^a"}, "to": {"path": "^b"}}]})
    st.watch(s, rs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "from", "to", "rule") == [("a/x", "b/y", "r")]


def _rule(name, frm=None, to=None):
    return {"name": name, "severity": "error", "from": frm or {}, "to": to or {}}


def test_watch_judges_every_edge_of_a_pair(spark, tmp_path, rows):
    src = tmp_path / "in"
    data = [("a", 0, "b", ["local"]), ("a", 1, "b", ["npm"]), ("a", 2, "b", ["core"]), ("a", 1, "b", ["npm"])]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(data)], "source string, ord long, resolved string, dependencyTypes array<string>, delivery int")
    df.coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema(df.schema).parquet(str(src))
    rs = ru.load({"forbidden": [_rule(t, {}, {"dependencyTypes": [t]}) for t in ("local", "npm", "core")]})
    st.watch(s, rs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "rule") == [("core",), ("local",), ("npm",)]


def test_watch_knows_the_stored_graph_or_refuses(spark, tmp_path, rows):
    src = tmp_path / "in"
    # x leads to y and z, y to z: instability 1, 1/2, 0
    old = spark.createDataFrame([("x", 0, "y"), ("x", 1, "z"), ("y", 0, "z")], "source string, ord long, resolved string")
    stored = Graph.of(old, spark.createDataFrame([("x", "python", "p"), ("y", "dotnet", "q"), ("z", "dotnet", "p")], "source string, language string, project string"))
    df = spark.createDataFrame([("z", 0, "y"), ("y", 1, "x")], "source string, ord long, resolved string")
    df.coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema(df.schema).parquet(str(src))
    near = [_rule("language", {"language": "dotnet"}, {"language": "python"}), _rule("project", {"project": "^p"}, {"project": "^q"}), _rule("unstable", {}, {"moreUnstable": True})]
    far = [_rule("circle", {}, {"circular": True}), _rule("reach", {"path": "^x"}, {"path": "^z", "reachable": True})]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    with pytest.raises(ValueError, match="language.*project.*unstable"):
        st.watch(s, ru.load({"forbidden": near}), out, cp)
    with pytest.raises(ValueError, match="circle.*reach"):
        st.watch(s, ru.load({"forbidden": near + far}), out, cp, stored=stored)
    st.watch(s, ru.load({"forbidden": near + far}), out, cp, stored=stored, left_out=["circle", "reach"]).awaitTermination()
    assert rows(spark.read.parquet(out), "from", "to", "rule") == [("y", "x", "language"), ("y", "x", "unstable"), ("z", "y", "project"), ("z", "y", "unstable")]


def test_windows_on_a_stream(spark, tmp_path, rows):
    src = tmp_path / "in"
    df = spark.createDataFrame([("r", "2026-01-01 00:10:00", 1), ("r", "2026-01-01 00:20:00", 2), ("r", "2026-01-01 05:00:00", 3), ("r", "2026-01-01 00:20:00", 2)], "repo string, t string, id int").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema(df.schema).parquet(str(src))
    once = st.first_deliveries(s, "t", ["id"], "1 hour")
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
    q = st.edge_windows(s, "t", "repo").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert rows(spark.table("w"), "repo", "edges") == [("r", 1), ("r", 3)]


def test_cache(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3).toDF("x")

    config = uuid.uuid4().hex  # results outlive a session: one that no earlier run has saved
    key = st.cache_key(config, spark.range(5).toDF("a"))
    assert key == st.cache_key(config, spark.range(5).toDF("a").repartition(3)) != st.cache_key("other", spark.range(5).toDF("a"))
    assert st.cached(spark, key, make).count() == 3 and st.cached(spark, key, make).count() == 3 and len(made) == 1
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", "1")], "path string, fingerprint string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("d", "1")], "path string, fingerprint string")
    assert sorted(map(tuple, st.changed_inputs(a, b).collect())) == [("d", "deleted"), ("n", "added"), ("y", "modified")]
