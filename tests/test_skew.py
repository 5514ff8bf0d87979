"""A build holding a third of all profiles: spread over tasks, results independent of layout."""

from pyspark.sql import functions as F

from histshift.operators import profiles as pr
from histshift.plans import catalog as C
from tests.conftest import SF01


def hot_pings(spark):
    """Adapter A with two of every three users moved to build day 2024-01-10 (hour kept)."""
    p = C.pings(spark, SF01)
    hot = F.concat(F.lit("20240110"), F.substring("app_build_id", 9, 6))
    return p.withColumn("app_build_id",
                        F.when(F.col("client_id").cast("int") % 3 != 0, hot).otherwise(F.col("app_build_id")))


def test_hot_build_is_spread_over_tasks(spark):
    cfg = C.CFG.with_(num_reps=200, partitions=16)
    prof = pr.profiles(hot_pings(spark), cfg)
    counts = {r.app_build_id: r["count"] for r in prof.groupBy("app_build_id").count().collect()}
    assert counts["20240110"] / sum(counts.values()) > 1 / 3
    # profiles leave their stage clustered by (client, build): the hot build spans tasks
    parts = prof.filter(F.col("app_build_id") == "20240110").select(F.spark_partition_id().alias("p"))
    assert parts.distinct().count() >= 8


def test_profile_files_hold_a_build_or_two_and_a_hot_build_is_split(spark):
    """What the replicate stage shuffles is bounded by the (file, build) pairs: each adds the
    build's cells once. The hot build spans files by its size, and a file holds a build or two."""
    from histshift.operators import bootstrap as bs
    from histshift.plans.comparison import run_comparison
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "3k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        run = run_comparison(hot_pings(spark), C.CFG)
        pairs = run.profile.groupBy("app_build_id", F.input_file_name().alias("f")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = {b: [r["count"] for r in pairs if r.app_build_id == b] for b in {r.app_build_id for r in pairs}}
    hot = files["20240110"]
    assert len(hot) >= 3 and max(hot) < 0.5 * sum(hot)
    assert len(files) > 5 and len(pairs) <= 2 * max(len({r.f for r in pairs}), len(files))
    cells = run.cells
    by_file = bs.rep_cells(run.profile.withColumn("app_build_id", F.concat("app_build_id", F.lit("/"), F.input_file_name())), C.CFG)
    assert cells.count() > 0 and by_file.count() <= 2 * max(map(len, files.values())) * cells.count()


def test_cells_keep_odd_builds_and_negative_bins(spark, cfg):
    from histshift.operators import bootstrap as bs
    rows = [("a", b, 1, [("h1", m, 1.0)]) for b in ("20240101", "2024é", "", "0", None) for m in (-(2 ** 31), -1, 0, 2 ** 31 - 1)]
    prof = spark.createDataFrame(rows, "client_id string, app_build_id string, num_client_pings long, "
                                       "bins array<struct<probe:string,metric:int,measure:double>>")
    got = {(r.app_build_id, r.probe, r.metric): r.wsum for r in bs.rep_cells(prof, cfg, [0]).collect()}
    want = {(b, "h1", m): 1.0 for _, b, _, [(_, m, _)] in rows} | {(b, None, None): 4.0 for _, b, *_ in rows}
    assert got == want


def test_statistics_spread_a_hot_build_without_broadcasts(spark):
    """Two thirds of the rows in one build and no broadcast: rows meet their build's row by
    (build, salt), and no exchange of rows by the build alone feeds an aggregate of them."""
    from histshift.operators import stats as st
    from tests.test_plans import plan
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("b"),
                                    (F.col("id") % 997).cast("double").alias("v"))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        q = st.box_stats(df, ["b"], "v")
        text = plan(q, "simple")
        assert "_salt" in text and "hashpartitioning(b" in text
        assert any("hashpartitioning(b" in line and "_salt" in line for line in text.splitlines())
        hot = [r for r in q.collect() if r.b == "hot"][0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    import numpy as np
    vals = np.array([k % 997 for k in range(30_000) if k % 3 > 0], float)
    assert (hot.lower, hot.middle, hot.upper, hot.n) == (*np.quantile(vals, [.25, .5, .75]), len(vals))


def test_hot_build_results_do_not_depend_on_layout(spark):
    from histshift.plans.comparison import run_comparison
    pings = hot_pings(spark)
    a = {(r.rep, r.app_build_id, r.probe): r.relds for r in run_comparison(pings, C.CFG).relds.collect()}
    b = {(r.rep, r.app_build_id, r.probe): r.relds
         for r in run_comparison(pings, C.CFG.with_(rep_block=5, partitions=3)).relds.collect()}
    assert a.keys() == b.keys() and len(a) > 0
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_newest_first_cuts_a_hot_build(spark):
    from histshift.operators import snapshots as sn
    df = spark.range(400_000).select(
        F.when(F.col("id") % 3 > 0, "20240110").otherwise(F.concat(F.lit("2024011"), F.col("id") % 10)).alias("app_build_id"),
        F.col("id").alias("v"), F.create_map(F.lit(1), F.col("id")).alias("m"))
    ordered = sn.newest_first(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # the data are small
    try:
        sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    builds = [r.app_build_id for r in ordered.select("app_build_id").collect()]
    assert builds == sorted(builds, reverse=True)
