"""The registered queries: one per operator of the inventory, on the driver's tables.

Settings (fixed for the correctness check): adapter A (``events``), probes
``hist_click … hist_view``, app 'app', channel 'nightly', final date 2024-01-15,
7 days, all clients (the sample_* keys set a cut), no estimator, R = 20, seed 0, measured replicate 0, md5
uniforms. Snapshot keys use the run history of 2024-01-15, -16 and -17. Outputs are
long rows; doubles are rounded to 6 decimals and dates rendered as 'yyyy-MM-dd'.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histshift.config import CLIENT_MEAN_QUANTILES, RunConfig
from histshift.functions.dates import build_date, build_day, window_predicate
from histshift.functions.histograms import merge_hist_maps
from histshift.functions.naming import percent_names, quantile_names
from histshift.operators import bootstrap as bs
from histshift.operators import profiles as pr
from histshift.operators import ranks
from histshift.operators import relds as rd
from histshift.operators import snapshots as sn
from histshift.plans import views as vw
from histshift.plans.comparison import RunResult, run_comparison
from histshift.plans.daily_job import daily_job, run_outputs
from histshift.plans.incremental import fold_pings, window_outputs
from histshift.plans.publish import publish_run, read_live
from histshift.plans.snapshots import build_snapshots, hists_snapshot, means_snapshot, relds_snapshot
from histshift.session import COLLECTING, fresh_path, settings
from histshift.sources import schemas
from histshift.sources.adapters import EVENT_PROBES, EVENT_TYPES, events_pings, lineitem_pings, LINEITEM_PROBES
from histshift.sources.published import Store
from histshift.sources.readers import probe_dim, read_csv_parts, read_json_hists, read_pings, read_snapshot
from histshift.sources.sinks import with_run_date, write_json_hists, write_pings, write_run, write_snapshot

FINAL = dt.date(2024, 1, 15)
CFG = RunConfig(probes=EVENT_PROBES, final_date=FINAL, num_days=7, num_reps=20,
                app="app", channel="nightly")
HISTORY = (dt.date(2024, 1, 15), dt.date(2024, 1, 16), dt.date(2024, 1, 17))
PROBE = "hist_click"
MEANS_PROBE = "hist_view"
VIEW_BUILDS = ("20240109", "20240111", "20240113")
SERIES_RANGE = ("2024-01-09", "2024-01-13")
METRIC_RANGE = (20, 100)
EVENT_LABELS = {t.upper(): p for t, p in zip(EVENT_TYPES, EVENT_PROBES)}
# Adapter B (scale) window: every ship month of the tables.
LINEITEM_CFG = RunConfig(probes=LINEITEM_PROBES, final_date=dt.date(2002, 1, 1),
                         num_days=2600, num_reps=20, app="app", channel="nightly")
RELDS_Q = quantile_names("relds", CFG.quantiles)


# Doubles are compared at 6 decimals. Sums in another order differ by ~1e-16, which
# flips a value lying exactly on a rounding tie (x.xxxxxx5); a 1e-12 nudge before
# rounding, applied identically by the oracle, keeps such ties on one side.
TIE_NUDGE = 1e-12


def out(df: DataFrame) -> DataFrame:
    """Round doubles to 6 decimals, render dates as text, keep everything else."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + F.lit(TIE_NUDGE), 6)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def pings(spark, sf) -> DataFrame:
    return events_pings(spark, sf)


def kept_pings(spark, sf) -> DataFrame:
    """The ping table written once, by build day, for queries of several runs: the adapter stands
    for a table that exists, so it works once and each run reads the days of its window."""
    path = fresh_path(spark, "kept-pings")
    with settings(spark, COLLECTING):
        write_pings(pings(spark, sf), path)
    return read_pings(spark, path)


def run(spark, sf, cfg: RunConfig = CFG) -> RunResult:
    return run_comparison(pings(spark, sf), cfg)


def history(spark, sf, cfg: RunConfig = CFG) -> list[dict[str, DataFrame]]:
    p = kept_pings(spark, sf)
    return [run_outputs(run_comparison(p, cfg.with_(final_date=d)), d) for d in HISTORY]


def hist_snapshot_single(spark, sf) -> DataFrame:
    """Build histograms of the 2024-01-15 run with their running sums (a one-run snapshot)."""
    r = run(spark, sf)
    return sn.hist_cdf(with_run_date(r.build_hists, FINAL))


def relds_table(spark, sf) -> DataFrame:
    return run(spark, sf).relds_quantiles


def means_table(spark, sf) -> DataFrame:
    return run(spark, sf).client_means


# ---------------------------------------------------------------- sources / sinks
def q_scan_pings(spark, sf):
    keys = ["client_id", "app_build_id", "app_name", "normalized_channel", "sample_id"]
    return out(pr.ping_bins(pings(spark, sf), EVENT_PROBES, keys).filter(F.col("probe").isNotNull()))


def q_client_build_pings(spark, sf):
    return out(pr.client_build_pings(pings(spark, sf), CFG))


def q_csv_roundtrip(spark, sf):
    path = fresh_path(spark, "relds_csv")
    for d, outs in zip(HISTORY, history(spark, sf)):
        write_run(outs["relds_csv"], path, d)
    return out(read_csv_parts(spark, path, schemas.relds_quantiles_schema()))


def q_json_hist(spark, sf):
    path = fresh_path(spark, "hists_json")
    write_json_hists(run(spark, sf).build_hists, path)
    return out(read_json_hists(spark, path))


def q_snapshot_read(spark, sf):
    path = fresh_path(spark, "snapshot")
    outs = history(spark, sf)
    write_snapshot(relds_snapshot(sn.union_strict([o["relds_csv"] for o in outs])), path)
    return out(read_snapshot(spark, path))


def q_measured_sink(spark, sf):
    path = fresh_path(spark, "relds_measured")
    write_run(run_outputs(run(spark, sf), FINAL)["relds_measured"], path, FINAL)
    return out(read_csv_parts(spark, path, schemas.relds_measured_schema(EVENT_PROBES)))


def q_means_sink(spark, sf):
    path = fresh_path(spark, "client_means")
    write_run(run_outputs(run(spark, sf), FINAL)["client_means"], path, FINAL)
    return out(read_csv_parts(spark, path, schemas.client_means_schema(EVENT_PROBES)))


def q_hist_sink_overwrite(spark, sf):
    """A same-day rerun replaces its partition: the second write must not duplicate rows."""
    path = fresh_path(spark, "probe_hists")
    outs = history(spark, sf)
    for o, d in zip(outs[:2], HISTORY):
        write_run(o["probe_hists"], path, d)
    write_run(outs[0]["probe_hists"], path, HISTORY[0])
    return out(read_csv_parts(spark, path, schemas.PROBE_HISTS))


# ---------------------------------------------------------------- projections / filters
def q_build_day(spark, sf):
    return out(pings(spark, sf).select("client_id", "app_build_id", build_day().alias("build_day")))


def q_build_window(spark, sf):
    p = pings(spark, sf).filter(window_predicate(CFG.final_date, CFG.num_days))
    return out(p.select("client_id", "app_build_id"))


def q_channel_filter(spark, sf):
    p = pings(spark, sf).filter(pr.channel_predicate(CFG))
    return out(p.select("client_id", "app_build_id", "app_name", "normalized_channel"))


def _sample(spark, sf, cfg):
    return out(pr.select_pings(pings(spark, sf), cfg).select("client_id", "app_build_id", "sample_id"))


def q_sample_lexical(spark, sf):
    return _sample(spark, sf, CFG.with_(sample="lexical"))


def q_sample_numeric(spark, sf):
    return _sample(spark, sf, CFG.with_(sample="numeric"))


def q_sample_debug(spark, sf):
    return _sample(spark, sf, CFG.with_(debug=True))


def q_struct_roundtrip(spark, sf):
    m = means_table(spark, sf)
    return out(pr.flatten_struct(pr.profile_struct(m, EVENT_PROBES)))


def q_build_date(spark, sf):
    b = pr.client_build_pings(pings(spark, sf), CFG).select("app_build_id").distinct()
    return out(b.select("app_build_id", build_date("app_build_id").alias("build_date")))


def q_build_detail(spark, sf):
    return out(vw.build_detail(relds_table(spark, sf), PROBE))


def q_hist_view(spark, sf):
    return out(vw.hist_view(hist_snapshot_single(spark, sf), VIEW_BUILDS, PROBE))


def q_hist_view_range(spark, sf):
    return out(vw.hist_view(hist_snapshot_single(spark, sf), VIEW_BUILDS, PROBE,
                            METRIC_RANGE, recompute=True))


def q_relds_series(spark, sf):
    return out(vw.relds_series(relds_table(spark, sf), PROBE, SERIES_RANGE))


def q_box_range(spark, sf):
    return out(vw.box_view(means_table(spark, sf), MEANS_PROBE, y_range=(0.0, 100.0)))


def q_means_quantiles(spark, sf):
    return out(vw.means_quantiles(means_table(spark, sf), PROBE, "2024-01-10"))


def q_regression_flags(spark, sf):
    f = rd.regression_flags(relds_table(spark, sf), 0.10)
    return out(f.select("probe", "app_build_id", "relds_95", "thresh"))


def q_default_window(spark, sf):
    return out(vw.default_window(relds_table(spark, sf)))


def q_hist_since(spark, sf):
    return out(vw.hist_since(hist_snapshot_single(spark, sf), "20240110", PROBE))


def q_relds_measured(spark, sf):
    return out(run(spark, sf).relds_measured)


def q_relds_bootstrap(spark, sf):
    return out(run(spark, sf).relds_bootstrap)


def q_box_log10(spark, sf):
    return out(vw.box_view(means_table(spark, sf), MEANS_PROBE, log10=True))


# ---------------------------------------------------------------- joins
def q_comparison_pairs(spark, sf):
    return out(run(spark, sf).comparison_pairs())


def q_probe_labels(spark, sf):
    j = vw.probe_labels(relds_table(spark, sf), probe_dim(spark, EVENT_LABELS))
    return out(j.select("label", "probe", "app_build_id", "relds_5"))


def q_bootstrap_weights(spark, sf):
    r = run(spark, sf)
    return out(bs.bootstrap_weights(r.profile.select("client_id", "app_build_id"), CFG))


def q_nearest_builds(spark, sf):
    return out(vw.nearest_builds(relds_table(spark, sf), PROBE, "2024-01-11", 0.5, k=3))


# ---------------------------------------------------------------- aggregations
def q_client_hists(spark, sf):
    return out(pr.client_hists(run(spark, sf).profile))


def q_client_hists_estimator(spark, sf):
    return out(pr.client_hists(run(spark, sf, CFG.with_(estimator=True)).profile))


def q_build_stats(spark, sf):
    return out(run(spark, sf).build_stats)


def q_rep_hists(spark, sf):
    return out(run(spark, sf).rep_hists)


def q_rep_sizes(spark, sf):
    return out(run(spark, sf).rep_sizes)


def zero_bin_pings(spark, sf) -> DataFrame:
    """Adapter A plus one extra bin (-1) in every non-null map: count 1 on even build
    days, 0 on odd ones, so controls carry zero-probability bins (the 0.10 rule)."""
    p = pings(spark, sf)
    day = F.substring("app_build_id", 7, 2).cast("int")
    extra = F.create_map(F.lit(-1), F.when(day % 2 == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return p.select(*[F.col(c) for c in p.columns if c not in EVENT_PROBES],
                    *[F.when(F.col(c).isNotNull(), F.map_concat(F.col(c), extra)).alias(c)
                      for c in EVENT_PROBES])


def q_relds_zero_val(spark, sf):
    return out(run_comparison(zero_bin_pings(spark, sf), CFG).relds)


def q_relds_quantiles(spark, sf):
    return out(relds_table(spark, sf))


def q_relds_quantiles_all(spark, sf):
    """Every client of every build in the tables: a window over all their days."""
    cfg = CFG.with_(num_days=60, final_date=dt.date(2024, 2, 15))
    return out(run(spark, sf, cfg).relds_quantiles)


def q_relds_quantiles_sampled(spark, sf):
    return out(run(spark, sf, CFG.with_(sample="lexical")).relds_quantiles)


def q_relds_quantiles_lineitem(spark, sf):
    return out(run_comparison(lineitem_pings(spark, sf), LINEITEM_CFG).relds_quantiles)


def q_distinct_builds(spark, sf):
    return out(vw.distinct_builds(hist_snapshot_single(spark, sf)))


def q_box_stats(spark, sf):
    return out(vw.box_view(means_table(spark, sf), MEANS_PROBE))


def q_box_outliers(spark, sf):
    return out(vw.box_outliers_view(means_table(spark, sf), MEANS_PROBE))


def q_violin_density(spark, sf):
    return out(vw.violin_view(means_table(spark, sf), MEANS_PROBE))


def q_violin_quantiles(spark, sf):
    from histshift.operators.stats import violin_quantiles
    return out(violin_quantiles(vw.violin_view(means_table(spark, sf), MEANS_PROBE), ["app_build_id"]))


def q_means_trend(spark, sf):
    return out(vw.trend_view(means_table(spark, sf), MEANS_PROBE))


def q_alerts_by_build(spark, sf):
    return out(rd.alerts_by_build(rd.regression_flags(relds_table(spark, sf), 0.10)))


# ---------------------------------------------------------------- windows
def q_latest_relds(spark, sf):
    return sn.newest_first(out(relds_snapshot(sn.union_strict([o["relds_csv"] for o in history(spark, sf)]))))


def q_latest_means(spark, sf):
    return sn.newest_first(out(means_snapshot(sn.union_strict([o["client_means"] for o in history(spark, sf)]))))


def q_latest_hists(spark, sf):
    return sn.newest_first(out(sn.latest_wins(
        sn.union_strict([o["probe_hists"] for o in history(spark, sf)]), sn.HISTS_KEYS)))


def q_latest_hists_by_probe(spark, sf):
    return out(sn.latest_wins(sn.union_strict([o["probe_hists"] for o in history(spark, sf)]),
                              sn.HISTS_KEYS_BY_PROBE))


def q_build_calendar(spark, sf):
    return out(run(spark, sf).calendar)


def q_hist_cdf(spark, sf):
    return out(hists_snapshot(sn.union_strict([o["probe_hists"] for o in history(spark, sf)])))


def q_hist_cdf_recomputed(spark, sf):
    h = hist_snapshot_single(spark, sf).filter(F.col("metric").between(*METRIC_RANGE))
    return out(sn.hist_cdf_recomputed(h.drop("cum_sum")))


# ---------------------------------------------------------------- set operations
def q_union_strict(spark, sf):
    return out(sn.union_strict([o["relds_csv"] for o in history(spark, sf)]))


def q_union_loose(spark, sf):
    outs = history(spark, sf)
    first = outs[0]["client_means"].drop(MEANS_PROBE)
    return out(sn.union_loose([first] + [o["client_means"] for o in outs[1:]]))


def q_latest_incremental(spark, sf):
    """Ten runs, day by day, folded one at a time."""
    p = kept_pings(spark, sf)
    days = [FINAL + dt.timedelta(days=k) for k in range(10)]
    runs = (run_outputs(run_comparison(p, CFG.with_(final_date=d)), d)["relds_csv"] for d in days)
    return out(sn.fold_runs(runs, sn.RELDS_KEYS))


# ---------------------------------------------------------------- jobs
def q_read_pings(spark, sf):
    """S1 through the reader: the ping table written as parquet and read back by path."""
    path = fresh_path(spark, "pings")
    pings(spark, sf).write.parquet(path)
    return out(pr.client_build_pings(read_pings(spark, path), CFG))


def _daily_runs(spark, sf, name: str) -> str:
    """Three daily jobs, a same-day rerun, and a run without any ping for a day written
    before (which has to leave that day empty)."""
    p, path = kept_pings(spark, sf), fresh_path(spark, name)
    extra = HISTORY[-1] + dt.timedelta(days=1)
    for d in (*HISTORY, HISTORY[0], extra):
        daily_job(spark, p, CFG.with_(final_date=d), path)
    daily_job(spark, p.limit(0), CFG.with_(final_date=extra), path)
    return path


def q_daily_job_outputs(spark, sf):
    """The client means that the daily jobs wrote."""
    path = _daily_runs(spark, sf, "daily")
    return out(read_csv_parts(spark, f"{path}/client_means", schemas.client_means_schema(EVENT_PROBES)))


def q_snapshots_from_csv(spark, sf):
    """E3 over the daily jobs' CSV outputs: the published histogram snapshot."""
    path = _daily_runs(spark, sf, "daily")
    return out(build_snapshots(spark, path, f"{path}/snapshots", EVENT_PROBES)["probe_hists"])


def q_csv_drift_loose(spark, sf):
    """Client means of three runs, one without a probe and one with its columns in
    another order, read by name."""
    path = fresh_path(spark, "drift")
    outs = [o["client_means"] for o in history(spark, sf)]
    frames = [outs[0].drop(MEANS_PROBE), outs[1].select(*reversed(outs[1].columns)), outs[2]]
    for df, d in zip(frames, HISTORY):
        write_run(df, path, d)
    return out(read_csv_parts(spark, path, schemas.client_means_schema(EVENT_PROBES)))


def q_csv_drift_in_run(spark, sf):
    """Client means of one run whose parts have three headers: whole rows, rows without
    a probe, and rows with their columns in another order."""
    path = f"{fresh_path(spark, 'drift-in-run')}/creation_date={FINAL:%Y-%m-%d}"
    means = run(spark, sf).client_means
    first = F.substring("client_id", -1, 1)
    for df in (means.where(first < "3"), means.where((first >= "3") & (first < "6")).drop(MEANS_PROBE),
               means.where(first >= "6").select(*reversed(means.columns))):
        df.write.mode("append").option("header", True).csv(path)
    return out(read_csv_parts(spark, path.rsplit("/", 1)[0], schemas.client_means_schema(EVENT_PROBES)))


def q_pruned_pings(spark, sf):
    """S1/P1/P2 over a ping table partitioned by build day: the window reads its days only."""
    path = fresh_path(spark, "pings-by-day")
    write_pings(pings(spark, sf), path)
    return out(pr.client_build_pings(read_pings(spark, path), CFG))


def arrival(late_days: int = 1):
    """The day on which a ping arrives: its build day, or later for a tenth of the clients."""
    day = build_date("app_build_id")
    late = F.pmod(F.xxhash64("client_id"), F.lit(10)) == 0
    return F.when(late, F.date_add(day, late_days)).otherwise(day)


def incremental_store(spark, sf, cfg: RunConfig = CFG) -> Store:
    """Ten days of pings folded one by one as they arrive, some a day late; one day twice."""
    path = fresh_path(spark, "arrivals")
    pings(spark, sf).withColumn("arrived", F.date_format(arrival(), "yyyyMMdd")).write.partitionBy("arrived").parquet(path)
    arrivals = spark.read.parquet(path)
    store = Store(spark, fresh_path(spark, "incremental"))
    days = [cfg.final_date - dt.timedelta(days=k) for k in range(9, -1, -1)]
    for d in (*days, days[4]):
        fold_pings(spark, store, arrivals.filter(F.col("arrived") == int(f"{d:%Y%m%d}")), cfg, f"{d:%Y-%m-%d}")
    return store


def q_incremental_run(spark, sf):
    """The window's quantiles, read from a store that each day's pings were folded into."""
    return out(window_outputs(incremental_store(spark, sf).current(), CFG).relds_quantiles)


def q_live_folded(spark, sf):
    """U4/K5: ten runs published day by day; each fold rewrites the builds that its run holds."""
    p, store = kept_pings(spark, sf), Store(spark, fresh_path(spark, "live"))
    for k in range(10):
        d = FINAL + dt.timedelta(days=k)
        outs = run_outputs(run_comparison(p, CFG.with_(final_date=d)), d)
        version = publish_run(store, {"relds_csv": outs["relds_csv"]}, d)
    return out(read_live(version, "relds"))


class _Interrupted(Store):
    """A store whose writer is lost before the histograms of a run are written."""

    def stage(self, table, *args, **kw):
        if table == "runs/probe_hists":
            raise InterruptedError(table)
        return super().stage(table, *args, **kw)


def q_published_after_failure(spark, sf):
    """K1-K5: two whole runs, then one that fails between its sinks: readers see the two."""
    path = fresh_path(spark, "published")
    for d, outs in zip(HISTORY, history(spark, sf)):
        try:
            publish_run(Store(spark, path) if d != HISTORY[-1] else _Interrupted(spark, path), outs, d)
        except InterruptedError:
            pass
    return out(read_live(Store(spark, path).current(), "client_means"))


def published_means(spark, sf):
    """A store with the client means of one run and their rank index."""
    store = Store(spark, fresh_path(spark, "means"))
    return publish_run(store, {"client_means": run_outputs(run(spark, sf), FINAL)["client_means"]}, FINAL)


def q_rank_quantiles(spark, sf):
    """A8 from the rank index: every build."""
    return out(ranks.group_quantiles(published_means(spark, sf), PROBE, CLIENT_MEAN_QUANTILES, percent_names(CLIENT_MEAN_QUANTILES)))


def q_rank_box(spark, sf):
    """A12 from the rank index."""
    return out(ranks.box_stats(published_means(spark, sf), MEANS_PROBE))


def q_rank_outliers(spark, sf):
    """A12's outliers from the rank index."""
    return out(ranks.box_outliers(published_means(spark, sf), MEANS_PROBE))


# ---------------------------------------------------------------- functions
def q_client_means(spark, sf):
    return out(means_table(spark, sf))


def q_hist_merge(spark, sf):
    """each build's histogram merged with the next newer build's, as maps."""
    r = run(spark, sf)
    as_map = F.map_from_entries(F.collect_list(F.struct("metric", "measure")))      # one probe's bins
    maps = r.build_hists.groupBy("app_build_id", "probe").agg(as_map.alias("hist"))
    control = maps.select(F.col("app_build_id").alias("control_build"), "probe", F.col("hist").alias("older"))
    both = r.calendar.join(control, "control_build").join(maps, ["app_build_id", "probe"], "left")
    return out(both.select("app_build_id", "probe", F.explode(merge_hist_maps("older", "hist")).alias("metric", "measure")))


def q_build_hists(spark, sf):
    return out(run(spark, sf).build_hists)


def hist_json(metric: str, measure: str):
    """F8: one histogram as a JSON object text, bins in ascending order (deterministic)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(metric), F.round(measure, 6).alias("v"))))
    return F.to_json(F.map_from_entries(F.transform(
        entries, lambda e: F.struct(e[metric].cast("string"), e["v"]))))


def exported_hists(spark, sf) -> DataFrame:
    """F8: (app_build_id, probe, hist_json)."""
    h = run(spark, sf).build_hists
    return h.groupBy("app_build_id", "probe").agg(hist_json("metric", "measure").alias("hist_json"))


def q_hist_json_export(spark, sf):
    """F8 in long form: the exported JSON text parsed again."""
    parsed = F.explode(F.from_json("hist_json", "map<string,double>")).alias("metric", "measure")
    return (exported_hists(spark, sf).select("app_build_id", "probe", parsed)
            .withColumn("metric", F.col("metric").cast("int")))


def q_relds_wide(spark, sf):
    return out(rd.relds_wide(run(spark, sf).relds, EVENT_PROBES))


# ---------------------------------------------------------------- composite views
def q_ridge_series(spark, sf):
    return out(vw.ridge_series(vw.hist_view(hist_snapshot_single(spark, sf), VIEW_BUILDS, PROBE)))


def q_cdf_series(spark, sf):
    return out(vw.cdf_series(vw.hist_view(hist_snapshot_single(spark, sf), VIEW_BUILDS, PROBE)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}
