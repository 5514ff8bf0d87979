"""End-to-end: the daily job writes four partitioned outputs that the snapshot build reads."""

import datetime as dt

from pyspark.sql import functions as F

from histshift.functions.histograms import merge_hist_maps
from histshift.plans import catalog as C
from histshift.plans import views as vw
from histshift.plans.daily_job import OUTPUTS, daily_job
from histshift.plans.snapshots import build_snapshots
from histshift.sources.readers import parse_hist_json
from tests.conftest import SF001


def test_daily_job_and_snapshots(spark, tmp_path):
    pings = C.pings(spark, SF001)
    out = str(tmp_path / "out")
    for d in C.HISTORY:
        paths = daily_job(spark, pings, C.CFG.with_(final_date=d), out)
    assert set(paths) == set(OUTPUTS)
    daily_job(spark, pings, C.CFG.with_(final_date=C.HISTORY[0]), out)     # same-day rerun
    snaps = build_snapshots(spark, out, str(tmp_path / "live"), C.EVENT_PROBES)
    relds = snaps["relds"]
    # one row per (build, probe): the rerun replaced its partition, latest wins
    assert relds.groupBy("app_build_id", "probe").count().filter("count > 1").count() == 0
    newest = relds.groupBy("app_build_id").agg(F.max("creation_date").alias("d")).collect()
    assert max(r.d for r in newest) == C.HISTORY[-1]
    hists = snaps["probe_hists"]
    ends = hists.groupBy("app_build_id", "probe", "creation_date").agg(F.max("cum_sum").alias("m"))
    assert ends.filter(F.abs(F.col("m") - 1) > 1e-9).count() == 0      # measured CDF ends at 1
    means = snaps["client_means"]
    assert "date" in means.columns and means.count() > 0
    assert vw.box_view(means, C.MEANS_PROBE).count() > 0
    assert vw.default_window(relds).collect()[0].max_build == relds.agg(F.max("app_build_id")).collect()[0][0]


def test_merge_hist_maps(spark):
    df = spark.createDataFrame([({1: 0.5, 2: 0.5}, {2: 0.25, 3: 0.75}), (None, {1: 1.0})],
                               "a map<int,double>, b map<int,double>")
    got = [dict(r.m) for r in df.select(merge_hist_maps("a", "b").alias("m")).collect()]
    assert got == [{1: 0.5, 2: 0.75, 3: 0.75}, {1: 1.0}]


def test_parse_hist_json(spark):
    df = spark.createDataFrame([('{"10": 3, "20": 1}',)], "s string")
    assert dict(df.select(parse_hist_json("s").alias("m")).collect()[0].m) == {10: 3, 20: 1}


def test_the_job_removes_its_intermediates(spark, tmp_path):
    import os
    from histshift.session import shared_dir
    folder = shared_dir(spark).removeprefix("file:") + "/histshift"
    daily_job(spark, C.pings(spark, SF001), C.CFG, str(tmp_path / "out"))
    assert not [f for f in os.listdir(folder) if f.startswith("daily_job")]


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest
    from histshift.session import shared_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        shared_dir(Session())
