"""Poisson weights and replicate histograms: determinism, distribution, layout invariance."""

import pytest
from pyspark.sql import functions as F

from histshift.functions.poisson import poisson1_thresholds
from histshift.operators import bootstrap as bs
from histshift.plans import catalog as C
from tests.conftest import SF001, SF01


def test_thresholds_are_the_poisson1_cdf():
    import math
    ts = poisson1_thresholds()
    cdf = 0.0
    for k, t in enumerate(ts):
        cdf += math.exp(-1) / math.factorial(k)
        assert abs(t / 2 ** 32 - cdf) < 1e-9
    assert ts == tuple(sorted(ts)) and ts[-1] < 2 ** 32


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_weights_have_poisson1_moments(spark, method):
    prof = spark.range(2000).select(F.col("id").cast("string").alias("client_id"),
                                    F.lit("20240110").alias("app_build_id"))
    cfg = C.CFG.with_(num_reps=100, uniform=method)
    w = bs.bootstrap_weights(prof, cfg).filter("rep > 0")
    n = 2000 * 100
    s = w.agg(F.sum("w").alias("s"), F.count("*").alias("c"), F.sum(F.col("w") * F.col("w")).alias("ss")).collect()[0]
    assert s.s / n == pytest.approx(1.0, abs=0.01)                 # mean 1
    assert s.c / n == pytest.approx(1 - 2.718281828 ** -1, abs=0.005)   # P(w > 0)
    assert s.ss / n - (s.s / n) ** 2 == pytest.approx(1.0, abs=0.02)   # variance 1


def test_weights_are_deterministic_and_rep0_is_one(spark):
    prof = spark.range(50).select(F.col("id").cast("string").alias("client_id"),
                                  F.lit("20240110").alias("app_build_id"))
    cfg = C.CFG.with_(num_reps=30)
    a = bs.bootstrap_weights(prof, cfg).collect()
    b = bs.bootstrap_weights(prof.repartition(7), cfg).collect()
    assert sorted(a) == sorted(b)
    assert all(r.w == 1 for r in a if r.rep == 0) and sum(r.rep == 0 for r in a) == 50
    seeded = bs.bootstrap_weights(prof, cfg.with_(seed=7)).collect()
    assert sorted(seeded) != sorted(a)


def test_rep_hists_are_unit_densities(spark):
    r = C.run(spark, SF001)
    s = r.rep_hists.groupBy("rep", "app_build_id", "probe").agg(F.sum("measure").alias("s"))
    assert s.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_rep_sizes_at_rep0_are_profile_counts(spark):
    r = C.run(spark, SF01)
    n0 = {x.app_build_id: x.n for x in r.rep_sizes.filter("rep = 0").collect()}
    st = {x.app_build_id: x.num_profiles for x in r.build_stats.collect()}
    assert n0 == st


@pytest.mark.parametrize("block,parts", [(1, 3), (7, 64), (1000, 1)])
def test_layout_does_not_change_results(spark, block, parts):
    base = C.run(spark, SF001).relds.collect()
    other = C.run(spark, SF001, C.CFG.with_(rep_block=block, partitions=parts)).relds.collect()
    key = lambda r: (r.rep, r.app_build_id, r.probe)
    a = {key(r): r.relds for r in base}
    b = {key(r): r.relds for r in other}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_relds_bounds(spark):
    r = C.run(spark, SF01)
    lo, hi = r.relds.agg(F.min("relds"), F.max("relds")).collect()[0]
    assert lo >= 0.0 and hi <= 2.0 + 0.10 * 200


def test_same_results_for_1_and_64_shuffle_partitions(spark):
    import __spark_entry__ as E
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    out = {}
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out[n] = {k: sorted(tuple(r) for r in E.queries()[k](spark, SF001).collect())
                      for k in ("relds_quantiles", "box_stats", "latest_hists")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert out["1"] == out["64"]
