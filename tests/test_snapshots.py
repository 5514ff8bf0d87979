"""Latest-wins, CDFs, unions, sinks and the incremental fold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from histshift.operators import snapshots as sn
from histshift.session import settings
from histshift.sources import schemas
from histshift.sources.readers import header_index, read_csv_parts, read_json_hists, require
from histshift.sources.sinks import with_run_date, write_json_hists, write_run

H = "app_build_id string, probe string, metric int, measure double, creation_date date"
D1, D2 = dt.date(2024, 1, 15), dt.date(2024, 1, 16)


def test_latest_tie_keeps_both(spark):
    df = spark.createDataFrame([("b", "p", 1, 0.5, D2), ("b", "p", 1, 0.5, D2), ("b", "p", 1, 0.9, D1)], H)
    assert sn.latest_wins(df, sn.RELDS_KEYS).count() == 2


def test_latest_by_metric_mixes_runs_by_probe_does_not(spark):
    rows = [("b", "p", 1, 0.4, D1), ("b", "p", 2, 0.6, D1), ("b", "p", 1, 1.0, D2)]
    df = spark.createDataFrame(rows, H)
    by_metric = {(r.metric, r.creation_date) for r in sn.latest_wins(df, sn.HISTS_KEYS).collect()}
    by_probe = {(r.metric, r.creation_date) for r in sn.latest_wins(df, sn.HISTS_KEYS_BY_PROBE).collect()}
    assert by_metric == {(1, D2), (2, D1)}
    assert by_probe == {(1, D2)}


def test_cdf_and_recomputed_cdf(spark):
    df = spark.createDataFrame([("b", "p", 1, .2, D1), ("b", "p", 2, .3, D1), ("b", "p", 3, .5, D1)], H)
    cdf = [round(r.cum_sum, 9) for r in sn.hist_cdf(df).orderBy("metric").collect()]
    assert cdf == [0.2, 0.5, 1.0]
    rec = sn.hist_cdf_recomputed(df.filter("metric >= 2"))
    assert [round(r.cum_sum, 9) for r in rec.orderBy("metric").collect()] == [0.375, 1.0]


def test_unions(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(2.0, 3)], "x double, k int")
    assert sorted(sn.union_strict([a, b]).collect()) == [(1, 2.0), (3, 2.0)]
    c = spark.createDataFrame([(4,)], "k int")
    with pytest.raises(Exception):
        sn.union_strict([a, c]).collect()
    assert sorted(sn.union_loose([c, a]).collect(), key=lambda r: r.k) == [(1, 2.0), (4, None)]


def test_incremental_fold_equals_batch(spark):
    rows = [("b1", "p", 1, 0.1, D1), ("b2", "p", 1, 0.2, D1), ("b2", "p", 1, 0.3, D2), ("b3", "p", 1, 0.4, D2)]
    runs = [spark.createDataFrame([r for r in rows if r[4] == d], H) for d in (D1, D2)]
    batch = sn.latest_wins(sn.union_strict(runs), sn.RELDS_KEYS).collect()
    assert sorted(sn.fold_runs(runs, sn.RELDS_KEYS).collect()) == sorted(batch)


def test_partition_overwrite_replaces_same_day(spark, tmp_path):
    df = spark.createDataFrame([("b", "p", 1, 0.5)], "app_build_id string, probe string, metric int, measure double")
    path = str(tmp_path / "hists")
    write_run(with_run_date(df, D1), path, D1)
    write_run(with_run_date(df, D2), path, D2)
    write_run(with_run_date(df, D1), path, D1)          # same-day rerun
    back = read_csv_parts(spark, path, schemas.PROBE_HISTS)
    assert sorted(r.creation_date for r in back.collect()) == [D1, D2]
    write_run(with_run_date(df.limit(0), D1), path, D1)          # an empty rerun empties its day
    assert [r.creation_date for r in read_csv_parts(spark, path, schemas.PROBE_HISTS).collect()] == [D2]


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    path, probes = str(tmp_path / "means"), ("p1", "p2", "p3")
    schema = schemas.client_means_schema(probes)
    wide = spark.createDataFrame([("c", "b", 1.0, 2.0, 3.0)], "client_id string, app_build_id string, p1 double, p2 double, p3 double")
    write_run(wide.select("p3", "app_build_id", "client_id", "p1"), path, D1)
    write_run(wide.select("p2", "p1", "p3", "client_id", "app_build_id"), path, D2)
    got = {r.creation_date: (r.client_id, r.p1, r.p2, r.p3) for r in read_csv_parts(spark, path, schema).collect()}
    assert got == {D1: ("c", 1.0, None, 3.0), D2: ("c", 1.0, 2.0, 3.0)}
    with pytest.raises(ValueError):
        read_csv_parts(spark, path, schema, strict=True)


MEANS = schemas.client_means_schema(("p1", "p2"))


def _put(path, run, name, *lines):
    (path / run).mkdir(parents=True, exist_ok=True)
    (path / run / name).write_text("".join(f"{x}\n" for x in lines))


def test_parts_of_one_run_are_read_by_their_own_headers(spark, tmp_path):
    day = "creation_date=2024-01-15"
    _put(tmp_path, day, "part-0.csv", "client_id,app_build_id,p1,p2", "a,b,1.0,2.0")
    _put(tmp_path, day, "part-1.csv", "p2,app_build_id,client_id", "4.0,b,c")
    _put(tmp_path, day, "part-2.csv", "", '"app_build_id","client_id","p1",extra', "b,d,5.0,x")
    _put(tmp_path, day, "part-3.csv")                                       # no line at all
    _put(tmp_path, day, "part-4.csv", "client_id,app_build_id,p1,p2")      # a header alone
    _put(tmp_path, day, "_SUCCESS", "not,a,part")
    _put(tmp_path, "creation_date=2024-01-16", "part 0%.csv", "client_id,app_build_id,p1,p2", "e,b,6.0,7.0")
    with settings(spark, {"spark.sql.files.maxPartitionNum": "1"}):      # asks for files packed into one task
        back = read_csv_parts(spark, str(tmp_path), MEANS)
    assert sorted((r.client_id, r.p1, r.p2, r.creation_date) for r in back.collect()) == [
        ("a", 1.0, 2.0, D1), ("c", None, 4.0, D1), ("d", 5.0, None, D1), ("e", 6.0, 7.0, D2)]
    with pytest.raises(ValueError):
        read_csv_parts(spark, str(tmp_path), MEANS, strict=True)
    _put(tmp_path, day, "part-5.csv", "client_id,app_build_id,p1,p1", "f,b,1.0,2.0")
    with pytest.raises(ValueError, match="repeat"):
        read_csv_parts(spark, str(tmp_path), MEANS)


def test_header_index_takes_the_first_line_of_long_parts(spark, tmp_path):
    """Splits after a part's first, and lines after its first, give no headers."""
    day = "creation_date=2024-01-15"
    _put(tmp_path, day, "part-0.csv", "client_id,app_build_id,p1", *(f"c{k},b,{k}.0" for k in range(200_000)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert [r.header for r in header_index(spark, str(tmp_path)).collect()] == ["client_id,app_build_id,p1"]
    assert read_csv_parts(spark, str(tmp_path), MEANS).agg(F.sum("p1")).first()[0] == sum(range(200_000))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_jobs_for_headers_do_not_grow_with_the_runs(spark, tmp_path):
    def jobs(runs):
        path = tmp_path / f"r{runs}"
        for k in range(runs):
            columns = "client_id,app_build_id,p1" if k % 2 else "app_build_id,p2,client_id"
            _put(path, f"creation_date={D1 + dt.timedelta(days=k)}", "part-0.csv", columns, "x,1,2")
        spark.sparkContext.setJobGroup(f"headers{runs}", "")
        try:
            df = read_csv_parts(spark, str(path), MEANS)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers{runs}"))
        assert df.count() == runs
        return n
    assert jobs(200) == jobs(80) < 10       # beyond 32 paths Spark also lists files by a job of its own


def test_no_runs_and_runs_without_parts_read_as_empty(spark, tmp_path):
    assert read_csv_parts(spark, str(tmp_path), MEANS).count() == 0
    (tmp_path / "creation_date=2024-01-15").mkdir()
    assert read_csv_parts(spark, str(tmp_path), MEANS).count() == 0


def test_a_missing_or_unreadable_measure_raises(spark, tmp_path):
    good = spark.createDataFrame([("b", "p", 1, "0.5")], "app_build_id string, probe string, metric int, measure string")
    for k, bad in enumerate(("text", None)):
        path = str(tmp_path / f"hists{k}")
        write_run(good.withColumn("measure", F.lit(bad).cast("string")), path, D1)
        with pytest.raises(Exception):
            require(read_csv_parts(spark, path, schemas.PROBE_HISTS), "measure").collect()


def test_json_hist_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("b", "p", 10, 0.25), ("b", "p", 20, 0.75)],
                               "app_build_id string, probe string, metric int, measure double")
    path = str(tmp_path / "json")
    write_json_hists(df, path)
    assert sorted(read_json_hists(spark, path).collect()) == sorted(df.collect())
