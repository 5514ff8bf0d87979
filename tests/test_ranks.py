"""The rank index against numpy and the scanning statistics."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from histshift.operators import ranks as R
from histshift.operators import stats as st
from histshift.plans import publish as P
from histshift.sources.published import Store


def a_store(spark, tmp_path, df, probes):
    store = Store(spark, str(tmp_path))
    return store.commit(store.current(), R.stage_index(store, df, probes))


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    return {"hot": np.round(rng.normal(100, 30, 30_000), 2), "ties": np.repeat([1.0, 2.0, 9.0], [500, 3, 2]),
            "one": np.array([4.0]), "two": np.array([-1.0, 5.0]), "far": np.r_[rng.normal(0, 1, 400), 50.0, 50.0, -70.0]}


@pytest.fixture(scope="module")
def version(spark, tmp_path_factory, groups):
    data = [(g, float(v), None) for g, vs in groups.items() for v in vs]
    data += [("hot", None, 1.0), ("hot", float("nan"), None), ("empty", None, None)]
    df = spark.createDataFrame(data, "app_build_id string, p double, q double")
    before = R.BLOCK
    try:
        R.BLOCK = 64
        return a_store(spark, tmp_path_factory.mktemp("ranks"), df, ["p", "q"])
    finally:
        R.BLOCK = before


def test_quantiles_equal_numpy(version, groups):
    qs = (0.0, 0.05, 0.25, 0.5, 0.7321, 0.95, 1.0)
    got = {r.app_build_id: list(r)[1:] for r in R.quantiles(version, "p", qs, list("abcdefg")).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, qs)), abs=1e-12)
    some = R.group_quantiles(version, "p", (0.5,), ("m",), ["two", "empty", "none"]).collect()
    assert sorted(map(tuple, some)) == [("empty", 1, None), ("two", 2, 2.0)]


def test_running_counts(version, groups):
    rows = version.read(R.ROWS).where("probe = 'p'").orderBy("app_build_id", "value").collect()
    for g, vs in groups.items():
        own = [r for r in rows if r.app_build_id == g]
        values, counts = np.unique(vs, return_counts=True)
        assert [(r.value, r.c) for r in own] == list(zip(values.tolist(), counts.tolist()))
        assert [r.before for r in own] == (np.cumsum(counts) - counts).tolist()
        assert [r.block for r in own] == sorted(r.block for r in own)


def test_boxes_and_outliers_equal_the_scanning_ones(spark, version, groups):
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "app_build_id string, value double")
    want = st.box_stats(df, ["app_build_id"], "value")
    got = R.box_stats(version, "p")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    out = sorted(map(tuple, R.box_outliers(version, "p").collect()))
    assert out == sorted(map(tuple, st.box_outliers(df, ["app_build_id"], "value").collect())) and len(out) > 100
    assert R.box_stats(version, "none").count() == 0


def scanned(df):
    """Rows that the scans of the index rows hand on."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.executedPlan().collectLeaves() if plan.nodeName().startswith("Adaptive") else plan.collectLeaves()
    todo = [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        x = todo.pop()
        name = x.nodeName()
        if "QueryStage" in name:
            inner = x.plan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif name.startswith("Scan") and "before" in str(x.schema()) and "value" in str(x.schema()):
            total += x.metrics().apply("numOutputRows").value()
    return total


def test_a_lookup_reads_a_share_of_the_rows(spark, tmp_path):
    n = 400_000
    df = spark.range(n).select(F.lit("b").alias("app_build_id"), (F.col("id") * 1.5).alias("p"))
    v = a_store(spark, tmp_path, df, ["p"])
    q = R.quantiles(v, "p", (0.05, 0.5, 0.95), list("abc"))
    assert list(q.collect()[0])[1:] == pytest.approx([1.5 * (n - 1) * x for x in (0.05, 0.5, 0.95)])
    assert 0 < scanned(q) <= 0.2 * n
    assert scanned(R.box_stats(v, "p")) <= 0.2 * n


def test_many_blocks_meet_the_rows_in_a_join(version, groups, monkeypatch):
    monkeypatch.setattr(R, "NAMED", 1)
    got = {r.app_build_id: r.m for r in R.quantiles(version, "p", (0.5,), ("m",)).collect()}
    assert got == pytest.approx({g: float(np.median(v)) for g, v in groups.items()})


def test_the_index_follows_the_published_snapshot(spark, tmp_path):
    schema = "client_id string, app_build_id string, h1 double, creation_date date"
    store = Store(spark, str(tmp_path))
    d1, d2 = dt.date(2024, 1, 15), dt.date(2024, 1, 16)

    def means(d, builds, shift):
        return spark.createDataFrame([(f"c{i}", b, float(i + shift), d) for b in builds for i in range(5)], schema)

    P.publish_run(store, {"client_means": means(d1, ["a", "b"], 0)}, d1)
    v = P.publish_run(store, {"client_means": means(d2, ["b", "c"], 100).withColumn("h2", F.lit(1.0))}, d2)
    got = {r.app_build_id: r.m for r in R.quantiles(v, "h1", (0.5,), ("m",)).collect()}
    assert got == {"a": 2.0, "b": 102.0, "c": 102.0}
    assert {r.app_build_id for r in R.quantiles(v, "h2", (0.5,), ("m",)).collect()} == {"b", "c"}
    assert {(r.app_build_id, r.h2) for r in P.read_live(v, "client_means").select("app_build_id", "h2").distinct().collect()} \
        == {("a", None), ("b", 1.0), ("c", 1.0)}
    v = P.publish_run(store, {"client_means": means(d2, ["c"], 7)}, d2)          # the rerun lost build b
    got = {r.app_build_id: r.m for r in R.quantiles(v, "h1", (0.5,), ("m",)).collect()}
    assert got == {"a": 2.0, "b": 2.0, "c": 9.0}
