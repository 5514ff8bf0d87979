"""RelDS statistic and build pairing (FIXTURES T10, quirks Q9-Q12)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from histshift.config import RunConfig
from histshift.operators import relds as rd
from histshift.plans.comparison import run_comparison
from tests.conftest import make_pings

CELLS = "rep int, app_build_id string, probe string, metric int, wsum double"


def relds_of(spark, control, test, zero_val=0.10):
    """RelDS of one comparison at rep 0 from hand-made (unnormalised) histograms."""
    cfg = RunConfig(probes=("p",), final_date=dt.date(2024, 1, 3), app="app", num_reps=1, zero_val=zero_val)
    rows = []
    for build, hist in (("20240101", control), ("20240102", test)):
        rows.append((0, build, None, None, 1.0))          # the build has a profile in rep 0
        rows += [(0, build, "p", k, float(v)) for k, v in hist.items()]
    cells = spark.createDataFrame(rows, CELLS)
    cal = rd.build_calendar(cells.select("app_build_id"))
    out = rd.relds(cells, cal, cfg).collect()
    assert len(out) == 1 and out[0].app_build_id == "20240102"
    return out[0].relds


@pytest.mark.parametrize("control,test,expected", [
    ({1: .5, 2: .5}, {1: .25, 2: .75}, 0.5),
    ({1: 1.0}, {1: .6, 9: .4}, 0.4),                 # test-only bin ignored
    ({1: 1.0, 9: 0.0}, {1: .6, 9: .4}, 0.5),         # zero rule: 0.4 + 0.10
    ({1: 1.0, 9: 0.0}, {1: 1.0, 9: 0.0}, 0.0),       # both zero: skipped
    ({1: .5, 2: .5}, {}, 1.0),                       # empty test
    ({}, {1: 1.0}, 0.0),                             # empty control
    ({1: 2, 2: 2}, {1: 1, 2: 3}, 0.5),               # normalised inside
])
def test_relds_cases(spark, control, test, expected):
    assert relds_of(spark, control, test) == pytest.approx(expected)


def test_zero_val_is_a_parameter(spark):
    assert relds_of(spark, {1: 1.0, 9: 0.0}, {1: .6, 9: .4}, zero_val=0.3) == pytest.approx(0.7)


def test_pair_order_and_calendar(spark):
    b = spark.createDataFrame([("20240101",), ("20240102",), ("20240104",)], "app_build_id string")
    got = sorted((r.app_build_id, r.control_build) for r in rd.build_calendar(b).collect())
    assert got == [("20240102", "20240101"), ("20240104", "20240102")]


def test_single_build_gives_empty_result_with_schema(spark, cfg):
    pings = make_pings(spark, [("a", "20240110093000", {"h1": {1: 1}}),
                               ("b", "20240110103000", {"h1": {2: 1}})])
    r = run_comparison(pings, cfg)
    assert r.relds.count() == 0
    assert r.relds_quantiles.count() == 0
    assert r.relds.columns == ["rep", "app_build_id", "probe", "relds"]


def test_identical_builds_have_zero_measured_relds(spark, cfg):
    rows = []
    for day in ("20240110", "20240111"):
        rows += [("a", day + "093000", {"h1": {1: 3, 2: 1}, "h2": {7: 1}}),
                 ("b", day + "093000", {"h1": {2: 5}})]
    r = run_comparison(make_pings(spark, rows), cfg)
    got = {x.probe: x.relds for x in r.relds_measured.collect()}
    assert got == {"h1": 0.0, "h2": 0.0}


def test_measured_rep_one_reproduces_the_written_behaviour(spark, cfg):
    from tests.conftest import SF001
    from histshift.plans import catalog as C
    r0 = C.run(spark, SF001)
    r1 = C.run(spark, SF001, C.CFG.with_(measured_rep=1))
    m1 = {(x.app_build_id, x.probe): x.relds for x in r1.relds_measured.collect()}
    all0 = {(x.app_build_id, x.probe, x.rep): x.relds for x in r0.relds.collect()}
    assert m1 == {(b, p): v for (b, p, rep), v in all0.items() if rep == 1}
    assert r1.relds_bootstrap.filter(F.col("rep") == 0).count() > 0


def test_quantiles_are_linear_interpolation(spark):
    cfg = RunConfig(probes=("p",), final_date=dt.date(2024, 1, 3), app="app")
    vals = [1.0, 2.5, 7.0, 9.0, None, 11.5]
    boot = spark.createDataFrame([(i + 1, "b", "p", v) for i, v in enumerate(vals)],
                                 "rep int, app_build_id string, probe string, relds double")
    stats = spark.createDataFrame([("b", 3, 4)], "app_build_id string, num_profiles long, build_pings long")
    q = rd.relds_quantiles(boot, stats, cfg).collect()[0]
    got = [q.relds_05, q.relds_1, q.relds_25, q.relds_5, q.relds_75, q.relds_9, q.relds_95]
    assert got == pytest.approx([1.3, 1.6, 2.5, 7.0, 9.0, 10.5, 11.0])
    assert (q.num_profiles, q.num_pings) == (3, 4)


def test_flag_at_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("p", "b", 0.10), ("p", "c", 0.0999)], "probe string, app_build_id string, relds_95 double")
    flags = {r.app_build_id: r.thresh for r in rd.regression_flags(df, 0.10).collect()}
    assert flags == {"b": True, "c": False}
