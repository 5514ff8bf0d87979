"""Benchmark: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf", ...}.
Every query runs to completion through the ``noop`` sink (all rows computed, nothing
collected). Settings follow the reference's daily job: R = 1000 replicates, 7 days.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def main() -> None:
    from pyspark.sql import functions as F

    from histshift.plans import catalog as C
    from histshift.plans import views as vw
    from histshift.plans.comparison import run_comparison
    from histshift.plans.daily_job import daily_job
    from histshift.plans.snapshots import build_snapshots
    from histshift.session import fresh_path, local_session
    from histshift.sources.adapters import events_pings, lineitem_pings

    spark = local_session(CPUS, shuffle_partitions=2 * CPUS, app="histshift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="histshift-bench-ckpt-"))

    times: dict[str, float] = {}

    def run(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    prod = C.CFG.with_(num_reps=1000, uniform="xxhash64")
    pings = events_pings(spark, SF_DIR)
    noop(run_comparison(pings, C.CFG).relds_quantiles)          # warm-up, not timed

    run("relds_quantiles_r1000", lambda: noop(run_comparison(pings, prod).relds_quantiles))
    run("relds_quantiles_r1000_md5",
        lambda: noop(run_comparison(pings, prod.with_(uniform="md5")).relds_quantiles))
    run("relds_measured_wide", lambda: noop(
        run_comparison(pings, prod).relds_measured.groupBy("app_build_id").pivot("probe").sum("relds")))
    li = lineitem_pings(spark, SF_DIR)
    li_cfg = C.LINEITEM_CFG.with_(num_reps=100, uniform="xxhash64")
    run("lineitem_profiles", lambda: noop(run_comparison(li, li_cfg).profile))
    run("lineitem_relds_quantiles_r100", lambda: noop(run_comparison(li, li_cfg).relds_quantiles))
    run("lineitem_client_means", lambda: noop(run_comparison(li, li_cfg).client_means))

    out_dir = fresh_path(spark, "bench-out")
    hist_cfg = prod.with_(num_reps=200)

    def history():
        for d in C.HISTORY:
            daily_job(spark, pings, hist_cfg.with_(final_date=d), out_dir)
    run("daily_job_x3_r200", history)
    snaps = {}

    def snapshots():
        snaps.update(build_snapshots(spark, out_dir, f"{out_dir}/snapshots", C.EVENT_PROBES))
    run("build_snapshots", snapshots)

    def views():
        means = snaps["client_means"]
        noop(vw.box_view(means, C.MEANS_PROBE))
        noop(vw.violin_view(means, C.MEANS_PROBE))
        noop(vw.trend_view(means, C.MEANS_PROBE))
        noop(vw.means_quantiles(means, C.PROBE, "2024-01-10"))
        noop(vw.relds_series(snaps["relds"], C.PROBE, ("2024-01-08", "2024-01-16")))
        noop(vw.hist_view(snaps["probe_hists"], C.VIEW_BUILDS, C.PROBE, C.METRIC_RANGE, True))
    run("dashboard_views", views)

    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": CPUS,
                      "replicates": 1000}))
    spark.stop()


if __name__ == "__main__":
    main()
