"""Client histograms, densities, means and sampling (FIXTURES T10, quirks Q2, Q3, Q6-Q8)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from histshift.operators import profiles as pr
from tests.conftest import make_pings

B = "20240110093000"


def dens(spark, cfg, rows):
    prof = pr.profiles(make_pings(spark, rows), cfg)
    out = {}
    for r in pr.client_hists(prof).collect():
        out.setdefault((r.client_id, r.probe), {})[r.metric] = round(r.measure, 9)
    return out, {r.client_id: r.num_client_pings for r in prof.collect()}


def test_null_map_is_skipped_but_ping_counts(spark, cfg):
    d, n = dens(spark, cfg, [("c", B, {"h1": {1: 2}}), ("c", B, {"h1": None})])
    assert d[("c", "h1")] == {1: 1.0}
    assert n["c"] == 2


def test_no_data_profile_still_counts(spark, cfg):
    rows = [("a", B, {"h1": None, "h2": None}), ("b", B, {"h1": {5: 1}})]
    prof = pr.profiles(make_pings(spark, rows), cfg)
    st = pr.build_stats(prof).collect()[0]
    assert st.num_profiles == 2 and st.build_pings == 2
    means = {r.client_id: r.h1 for r in pr.client_means(prof, cfg.probes).collect()}
    assert means["a"] is None and means["b"] == 5.0


def test_poisoned_histogram_empties_that_probe_only(spark, cfg):
    d, _ = dens(spark, cfg, [("c", B, {"h1": {1: 2}, "h2": {4: 1}}), ("c", B, {"h1": {3: None}})])
    assert ("c", "h1") not in d
    assert d[("c", "h2")] == {4: 1.0}


def test_all_zero_without_estimator_is_empty(spark, cfg):
    d, _ = dens(spark, cfg, [("c", B, {"h1": {1: 0, 2: 0}})])
    assert ("c", "h1") not in d


def test_all_zero_with_estimator(spark, cfg):
    d, _ = dens(spark, cfg.with_(estimator=True), [("c", B, {"h1": {1: 0, 2: 0}})])
    assert d[("c", "h1")] == {1: 0.5, 2: 0.5}


def test_estimator_adds_half_to_present_bins(spark, cfg):
    rows = [("c", B, {"h1": {1: 0, 2: 1}})]
    assert dens(spark, cfg.with_(estimator=True), rows)[0][("c", "h1")] == {1: 0.25, 2: 0.75}
    assert dens(spark, cfg, rows)[0][("c", "h1")] == {1: 0.0, 2: 1.0}


def test_pings_of_one_day_are_summed(spark, cfg):
    rows = [("c", "20240110010000", {"h1": {1: 1}}), ("c", "20240110230000", {"h1": {1: 1, 2: 2}})]
    d, n = dens(spark, cfg, rows)
    assert d[("c", "h1")] == {1: 0.5, 2: 0.5} and n["c"] == 2


def test_mean(spark, cfg):
    prof = pr.profiles(make_pings(spark, [("c", B, {"h1": {10: 1, 20: 3}})]), cfg)
    assert pr.client_means(prof, cfg.probes).collect()[0].h1 == pytest.approx(17.5)


def test_unpadded_sample_ids_compare_as_strings(spark, cfg):
    df = spark.createDataFrame([(str(i),) for i in range(100)], "sample_id string")
    lex = cfg.with_(sample="lexical")
    assert df.filter(pr.sample_predicate(lex)).count() == 68
    assert df.filter(pr.sample_predicate(lex.with_(channel="beta"))).count() == 18
    assert df.filter(pr.sample_predicate(cfg)).count() == 70
    assert df.filter(pr.sample_predicate(lex.with_(debug=True))).collect() == [("42",)]
    assert df.filter(pr.sample_predicate(cfg.with_(sample="all"))).count() == 100
    assert df.filter(pr.sample_predicate(cfg.with_(sample_cut="10"))).count() == 10


def test_window_end_excludes_final_day_as_written(spark, cfg):
    rows = [("a", "20190114093000", {"h1": {1: 1}}), ("b", "20190115093000", {"h1": {1: 1}})]
    c = cfg.with_(final_date=dt.date(2019, 1, 15))
    got = pr.client_build_pings(make_pings(spark, rows), c).collect()
    assert [r.client_id for r in got] == ["a"]
    got = pr.client_build_pings(make_pings(spark, rows), c.with_(inclusive_end=True)).collect()
    assert sorted(r.client_id for r in got) == ["a", "b"]


def test_densities_sum_to_one(spark, cfg):
    from tests.conftest import SF01
    from histshift.plans import catalog as C
    prof = C.run(spark, SF01).profile
    sums = pr.client_hists(prof).groupBy("client_id", "app_build_id", "probe").agg(F.sum("measure").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_missing_probe_is_rejected(spark, cfg):
    with pytest.raises(ValueError):
        pr.select_pings(make_pings(spark, [("c", B, {})], probes=("h1",)), cfg)


def test_profile_and_stats_follow_the_declared_schemas(spark, cfg):
    from histshift.sources import schemas
    prof = pr.profiles(make_pings(spark, [("c", B, {"h1": {1: 1}})]), cfg)

    def shape(schema):
        return [(f.name, f.dataType.simpleString()) for f in schema.fields]
    assert shape(prof.schema) == shape(schemas.profile_schema(cfg.probes))
    assert shape(pr.build_stats(prof).schema) == shape(schemas.BUILD_STATS)
