"""Physical plan shape: no Python in the plan, no cartesian products, broadcasts only
where bounded, predicates and projections pushed into the ping scan."""

import re

import pytest

from histshift.operators import bootstrap as bs
from histshift.operators import profiles as pr
from histshift.plans import catalog as C
from tests.conftest import SF001, make_pings


def plan(df, mode: str = "formatted") -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def test_flagship_plan_has_no_python_and_no_cartesian(spark):
    p = plan(C.run(spark, SF001).relds_quantiles)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in p
    assert "BroadcastHashJoin" in p


@pytest.mark.parametrize("name", ["client_means", "box_stats", "violin_density", "probe_labels", "means_trend",
                                  "relds_wide", "hist_cdf_recomputed"])
def test_planned_queries_are_free_of_python(spark, name):
    p = plan(C.QUERIES[name](spark, SF001), "simple")
    assert "Python" not in p and "CartesianProduct" not in p


def test_ping_scan_pushdown_and_pruning(spark, tmp_path, cfg):
    rows = [("a", "20240110093000", {"h1": {1: 1}}), ("b", "20240101093000", {"h2": {1: 1}})]
    path = str(tmp_path / "pings")
    make_pings(spark, rows).withColumn("extra", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x")) \
        .write.parquet(path)
    from histshift.sources.readers import read_pings
    pings = read_pings(spark, path)
    text = plan(pr.client_build_pings(pings, cfg))
    pushed = text.split("PushedFilters: ")[1].split("\n")[0]
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "GreaterThanOrEqual(app_build_id,20240108)" in pushed
    assert "LessThanOrEqual(app_build_id,20240115)" in pushed and "EqualTo(app_name,app)" in pushed
    assert "extra" not in schema and "h1" not in schema


def test_ping_source_is_not_rescanned_after_materialisation(spark):
    r = C.run(spark, SF001)
    p = plan(r.relds_quantiles)
    assert "events.parquet" not in p          # every branch reads the materialised profile
    assert "profile-" in p and "build_stats-" in p


def test_replicate_aggregation_shuffles_cells_only(spark):
    """Profile table -> expansion -> partial aggregation in one stage; one exchange of cells."""
    r = C.run(spark, SF001)
    p = plan(r.cells, "simple")
    assert p.count("Exchange hashpartitioning(rep") == 1 == p.count("Exchange hashpartitioning")


def test_measured_outputs_expand_one_replicate(spark):
    r = C.run(spark, SF001, C.CFG.with_(num_reps=500))
    for df in (r.relds_measured, r.build_hists):
        assert set(re.findall(r"sequence\((\d+), (\d+)", plan(df, "extended"))) == {("0", "0")}
    assert bs.replicate_blocks(r.cfg, [0]) == [(0, 0)] and bs.replicate_blocks(r.cfg)[-1] == (441, 500)


def test_folding_keeps_the_plan_small(spark):
    from histshift.operators import snapshots as sn
    runs = [spark.createDataFrame([("b", "p", k)], "app_build_id string, probe string, creation_date int") for k in range(6)]
    p = plan(sn.fold_runs(runs, sn.RELDS_KEYS), "simple")
    assert p.count("FileScan") == 1 and "Join" not in p
