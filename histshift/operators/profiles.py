"""Ping selection and client profiles.

Physical shape: one scan of the ping table with the window, app, channel and sample
predicates pushed to the reader; one shuffle, of pings whose maps are packed into three arrays,
by ranges of (build, client), so that a partition holds a build or two, a hot build spans several
and a (client, build) is in one. All that follows happens there: bins are exploded, sorted and summed by
(client, build, probe, bin), then the per-profile aggregation collects them and sums the totals
that normalise them. Probe means are sums of that same aggregation. A profile holds at most
``probes x distinct bins`` elements, a bound set by the histogram layout, not the data. The bins of
a fold (``client_bins``) are summed before they are shuffled, and once more by (client, build).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histshift.config import RunConfig
from histshift.functions.dates import BUILD_DAY, build_day, day_predicate, window_predicate
from histshift.functions.histograms import estimated


def check_probes(pings: DataFrame, probes) -> None:
    missing = [p for p in probes if p not in pings.columns]
    if missing:
        raise ValueError(f"probes not in the ping table: {missing}")


def sample_predicate(cfg: RunConfig, col: str = "sample_id") -> Column:
    """Client sampling. 'all' keeps every client; 'lexical' compares strings as the
    reference does (Q2: unpadded ids 0..99 keep 68 values for '70'); 'numeric' compares
    integers."""
    c = F.col(col)
    if cfg.debug:
        return c == F.lit(cfg.cut)
    if cfg.sample == "all":
        return F.lit(True)
    if cfg.sample == "numeric":
        return F.expr(f"try_cast({col} AS INT)") < F.lit(int(cfg.cut))
    return c < F.lit(cfg.cut)


def channel_predicate(cfg: RunConfig) -> Column:
    """Constant equality predicates; the channel is the run's channel (Q4)."""
    return (F.col("app_name") == F.lit(cfg.app)) & (F.col("normalized_channel") == F.lit(cfg.channel))


def select_pings(pings: DataFrame, cfg: RunConfig) -> DataFrame:
    """The pings of one run (window, app, channel, sample), columns untouched. Where the
    table is partitioned by build day, the window prunes partitions too."""
    check_probes(pings, cfg.probes)
    cond = window_predicate(cfg.final_date, cfg.num_days, cfg.inclusive_end)
    if BUILD_DAY in pings.columns:
        cond = day_predicate(cfg.final_date, cfg.num_days) & cond
    return pings.filter(cond & population_predicate(cfg))


def population_predicate(cfg: RunConfig) -> Column:
    """App, channel and client sample, without the window."""
    return channel_predicate(cfg) & sample_predicate(cfg)


def client_build_pings(pings: DataFrame, cfg: RunConfig) -> DataFrame:
    """A1: one row per (client, build day) with the number of pings."""
    return (select_pings(pings, cfg)
            .groupBy("client_id", build_day().alias("app_build_id"))
            .agg(F.count(F.lit(1)).alias("num_client_pings")))


PING_MARKER = "__ping__"
HIST = "map<int,bigint>"   # values nullable: a NULL count must stay NULL


def check_marker(probes) -> None:
    if PING_MARKER in probes:
        raise ValueError(f"{PING_MARKER} is reserved")


def ping_bins(pings: DataFrame, probes, keys) -> DataFrame:
    """Long form of the ping table: (keys…, probe, metric, value), one row per bin of
    every non-null map, plus one marker row per ping (probe and metric NULL, value 1).

    An ``unpivot`` of the probe maps (with a constant one-entry map standing for the
    marker) followed by ``explode``: both are code-generated, so no per-element lambda
    runs over the ping table. A null map yields no row (A2); a null count inside a map
    is kept as a NULL value so the caller can poison that histogram (Q6).
    """
    check_marker(probes)
    cols = [F.col(p).cast(HIST).alias(p) for p in probes]
    cols += [F.create_map(F.lit(0), F.lit(1).cast("bigint")).cast(HIST).alias(PING_MARKER)]
    wide = pings.select(*keys, *cols)
    long = wide.unpivot(list(keys), [*probes, PING_MARKER], "probe", "_hist")
    ex = long.select(*keys, "probe", F.explode("_hist").alias("metric", "value"))
    data = F.col("probe") != F.lit(PING_MARKER)
    return ex.select(*keys, F.when(data, F.col("probe")).alias("probe"),
                     F.when(data, F.col("metric")).alias("metric"), "value")


BIN_KEYS = ("client_id", "app_build_id", "probe", "metric")


def client_bins(selected: DataFrame, cfg: RunConfig) -> DataFrame:
    """Per (client, build, probe, metric) of selected pings: summed count and a poison flag;
    marker rows (probe NULL) carry the ping count of the (client, build). Bins of other
    pings of the same clients and builds can be merged in (``merged_bins``)."""
    sel = selected.select("client_id", build_day().alias("app_build_id"), *cfg.probes)
    exploded = ping_bins(sel, cfg.probes, ["client_id", "app_build_id"])
    return exploded.groupBy(*BIN_KEYS).agg(
        F.sum("value").alias("cnt"),
        F.bool_or(F.col("value").isNull()).alias("poisoned"))


def merged_bins(bins: DataFrame) -> DataFrame:
    """Bins summed over several sets of pings: counts add up, a poisoned bin stays poisoned."""
    return bins.groupBy(*BIN_KEYS).agg(F.sum("cnt").alias("cnt"), F.bool_or("poisoned").alias("poisoned"))


def dealt_pings(selected: DataFrame, cfg: RunConfig) -> DataFrame:
    """Selected pings by ranges of (build, client): ``_places``, ``_metrics`` and ``_counts`` hold the
    bins of all probes, each with its probe's position in the configured list, from 1. The first
    element, of place 0, is the ping itself. Unlike maps, three arrays take few bytes to shuffle.
    """
    check_marker(cfg.probes)
    maps = [F.col(p).cast(HIST) for p in cfg.probes]
    keys = [F.coalesce(F.map_keys(m), F.array().cast("array<int>")) for m in maps]
    counts = [F.coalesce(F.map_values(m), F.array().cast("array<bigint>")) for m in maps]
    places = [F.array_repeat(F.lit(i).cast("smallint"), F.size(k)) for i, k in enumerate(keys, start=1)]
    packed = selected.select("client_id", build_day().alias("app_build_id"),
                             F.concat(F.array(F.lit(0).cast("smallint")), *places).alias("_places"),
                             F.concat(F.array(F.lit(0)), *keys).alias("_metrics"),
                             F.concat(F.array(F.lit(1).cast("bigint")), *counts).alias("_counts"))
    # without an explicit count AQE merges small partitions
    fixed = [int(cfg.partitions)] if cfg.partitions else []
    return packed.repartitionByRange(*fixed, "app_build_id", "client_id")


def profiles(pings: DataFrame, cfg: RunConfig) -> DataFrame:
    """T2 of the pings of one run (see ``profiles_of``), dealt by ranges of (build, client)."""
    bins = dealt_pings(select_pings(pings, cfg), cfg).select(
        "client_id", "app_build_id",
        F.inline(F.arrays_zip("_places", "_metrics", "_counts")).alias("_place", "metric", "value"))
    # place and metric as one key; metrics may be negative
    cell = F.col("_place") * F.lit(1 << 32) + F.col("metric").cast("long")
    keys = ["client_id", "app_build_id", "_cell"]
    rows = bins.select("client_id", "app_build_id", cell.alias("_cell"), "metric", "value").sortWithinPartitions(*keys)
    # under COLLECTING this one sort serves both aggregations, and no hash map holds the bins. The metric is in
    # the key and still taken by first(): below sums and the like alone Spark would drop the sort
    agg = rows.groupBy(*keys).agg(
        F.sum("value").alias("cnt"),
        F.bool_or(F.col("value").isNull()).alias("poisoned"),
        F.first("metric").alias("metric"))
    place = F.shiftright(F.col("_cell") + F.lit(1 << 31), 32).cast("smallint")
    agg = agg.select("client_id", "app_build_id", place.alias("place"), "metric", "cnt", "poisoned")
    return _collected(agg, cfg)


def profiles_of(agg: DataFrame, cfg: RunConfig) -> DataFrame:
    """(client_id, app_build_id, num_client_pings, bins array<struct<probe,metric,measure>>,
    means struct of one histogram mean per probe, F3: NULL when empty or zero).

    bins are unit densities per probe (F1), after the optional +0.5 estimator (F2).
    A null count anywhere in a client's probe empties that probe (Q6); a probe whose
    counts are all zero without estimator is empty instead of failing (Q7). Profiles
    without any bin keep an empty array and still count (Q8).
    """
    # This second shuffle carries summed bins only. A hot build spreads over all tasks with its
    # clients. Without an explicit count AQE merges small partitions.
    if cfg.partitions:
        agg = agg.repartition(int(cfg.partitions), "client_id", "app_build_id")
    else:
        agg = agg.repartition("client_id", "app_build_id")
    names = F.array(*[F.lit(p) for p in cfg.probes])
    place = F.coalesce(F.array_position(names, F.col("probe")), F.lit(0)).cast("smallint")
    return _collected(agg.select("client_id", "app_build_id", place.alias("place"), "metric", "cnt", "poisoned"), cfg)


def _collected(agg: DataFrame, cfg: RunConfig) -> DataFrame:
    """Profiles of summed bins (client_id, app_build_id, place, metric, cnt, poisoned), which are already
    dealt by client and build; place 0 has the ping count. One aggregation collects a profile's
    bins beside the probes' totals that normalise them."""
    names = F.array(*[F.lit(p) for p in cfg.probes])
    est = estimated(F.col("cnt"), cfg.estimator)
    n = len(cfg.probes)
    # what is collected and summed is a plain column: collect_list interprets what it is given
    rows = agg.select("client_id", "app_build_id", "place", "poisoned", "cnt", est.alias("_est"),
                      (F.col("metric") * est).alias("_weighed"),
                      F.when(F.col("place") != 0, F.struct("place", "metric", est.alias("est"))).alias("_bin"))

    def own(i, col):
        return F.when(F.col("place") == i + 1, F.col(col))

    sums = rows.groupBy("client_id", "app_build_id").agg(
        F.coalesce(F.sum(F.when(F.col("place") == 0, F.col("cnt"))), F.lit(0))
         .cast("bigint").alias("num_client_pings"),
        F.collect_list("_bin").alias("_bins"),
        *[F.sum(own(i, "_est")).alias(f"_total{i}") for i in range(n)],
        *[F.sum(own(i, "_weighed")).alias(f"_weighed{i}") for i in range(n)],
        *[F.bool_or(own(i, "poisoned")).alias(f"_bad{i}") for i in range(n)])
    # NULL where the probe is poisoned or all zero: neither densities nor a mean
    totals = [F.when(~F.col(f"_bad{i}") & (F.col(f"_total{i}") != 0), F.col(f"_total{i}")) for i in range(n)]
    kept = sums.select("client_id", "app_build_id", "num_client_pings", "_bins", F.array(*totals).alias("_totals"),
                       F.struct(*[F.try_divide(F.col(f"_weighed{i}"), t).alias(p)
                                  for i, (p, t) in enumerate(zip(cfg.probes, totals))]).alias("means"))
    dens = F.transform("_bins", lambda b: F.struct(
        F.get(names, b["place"] - 1).alias("probe"), b["metric"].alias("metric"),
        F.try_divide(b["est"], F.get("_totals", b["place"] - 1)).alias("measure")))
    return kept.select("client_id", "app_build_id", "num_client_pings",
                       F.filter(dens, lambda b: b["measure"].isNotNull()).alias("bins"), "means")


def client_hists(profile: DataFrame) -> DataFrame:
    """A3/F1 in long form: (client_id, app_build_id, probe, metric, measure). Narrow."""
    return profile.select("client_id", "app_build_id", F.inline("bins"))


def build_stats(profile: DataFrame) -> DataFrame:
    """A4: per build, profiles (with or without data, Q8) and pings."""
    return profile.groupBy("app_build_id").agg(
        F.count(F.lit(1)).alias("num_profiles"),
        F.sum("num_client_pings").alias("build_pings"))


def client_means(profile: DataFrame, probes) -> DataFrame:
    """histogram mean per client, build and probe, wide (one column per probe): narrow,
    the profile aggregation has summed them."""
    return profile.select("client_id", "app_build_id", *[F.col("means")[p].alias(p) for p in probes])


def profile_struct(df: DataFrame, probes, name: str = "hist_mean") -> DataFrame:
    """Pack the probe columns into one struct column."""
    keys = [c for c in df.columns if c not in probes]
    return df.select(*keys, F.struct(*[F.col(p) for p in probes]).alias(name))


def flatten_struct(df: DataFrame, name: str = "hist_mean") -> DataFrame:
    """Flatten a struct column back into columns."""
    keys = [c for c in df.columns if c != name]
    return df.select(*keys, f"{name}.*")
