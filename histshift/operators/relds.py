"""Build pairing, RelDS and its summaries.

The comparison of a build with its predecessor needs both replicate histograms side by
side. Instead of a self-join, every aggregated cell is routed to the comparisons it
belongs to (as control of the next build, as test of its own) through a join with the
build calendar, and one grouping per (rep, comparison, probe) holds both
histograms, at most twice the number of bins of one probe. Calendar and build stats are a
row per build; no hint is given, the planner broadcasts them when their size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histshift.config import RunConfig
from histshift.functions.naming import quantile_names

def build_calendar(builds: DataFrame) -> DataFrame:
    """(app_build_id, control_build): each build against the previous one.

    The oldest build is never a test. Input is the distinct build list, bounded by
    the days of the window, so the global ordering window sees at most that many rows.
    """
    d = builds.select("app_build_id").distinct()
    prev = F.lag("app_build_id").over(Window.orderBy("app_build_id"))
    return d.select("app_build_id", prev.alias("control_build")).filter(
        F.col("control_build").isNotNull())


def comparison_pairs(sizes: DataFrame, calendar: DataFrame, cfg: RunConfig) -> DataFrame:
    """(rep, app_build_id, control_build, n_test, n_control) for every replicate in
    which both builds have weighted profiles (others have no RelDS, Q11)."""
    t = sizes.withColumnRenamed("n", "n_test")
    c = sizes.select("rep", F.col("app_build_id").alias("control_build"),
                     F.col("n").alias("n_control"))
    return t.join(calendar, "app_build_id").join(c, ["rep", "control_build"]).select(
        "rep", "app_build_id", "control_build", "n_test", "n_control")


def _roles(calendar: DataFrame) -> DataFrame:
    """(app_build_id, role, test_build): where each build's cells are needed
    (one pass over the calendar)."""
    both = F.array(
        F.struct(F.col("control_build").alias("app_build_id"), F.lit("c").alias("role"),
                 F.col("app_build_id").alias("test_build")),
        F.struct(F.col("app_build_id").alias("app_build_id"), F.lit("t").alias("role"),
                 F.col("app_build_id").alias("test_build")))
    return calendar.select(F.inline(both))


def relds(cells: DataFrame, calendar: DataFrame, cfg: RunConfig) -> DataFrame:
    """Long (rep, app_build_id, probe, relds) for every test build and replicate.

    ``cells`` are summed (one row per rep, build, probe and metric), so what is routed is
    independent of the number of profiles. They meet their comparisons in the calendar, then one
    repartition by (rep, comparison, probe) serves the three steps that follow without
    another shuffle: pairing control and test per bin, the per-histogram totals
    (window), and the sum over control bins. Groups whose comparison lacks one side in
    that replicate are dropped (Q11); a probe with no bins on either side gets 0.0 (Q10).
    Only control bins contribute (Q9); zero-probability bins are kept for the zero rule.
    """
    roles = _roles(calendar)
    probes = F.array(*[F.lit(p) for p in cfg.probes])
    routed = cells.join(roles, "app_build_id").select(
        "rep", "test_build", "role", "metric", "wsum",
        F.explode(F.when(F.col("probe").isNull(), probes).otherwise(F.array("probe"))).alias("probe"))
    routed = routed.repartition("rep", "test_build", "probe")
    paired = routed.groupBy("rep", "test_build", "probe", "metric").agg(
        F.sum(F.when(F.col("role") == "c", F.col("wsum"))).alias("vc"),
        F.sum(F.when(F.col("role") == "t", F.col("wsum"))).alias("vt"))
    marker = F.col("metric").isNull()
    # bins in order, so that sums don't depend on which tasks the cells come from
    hist = (Window.partitionBy("rep", "test_build", "probe").orderBy("metric")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tot = paired.select(
        "*", F.sum(F.when(~marker, F.col("vc"))).over(hist).alias("tc"),
        F.sum(F.when(~marker, F.col("vt"))).over(hist).alias("tt"))
    p_c = F.try_divide(F.col("vc"), F.col("tc"))
    p_t = F.coalesce(F.try_divide(F.col("vt"), F.col("tt")), F.lit(0.0))
    zero = F.lit(float(cfg.zero_val))
    term = F.when(~marker & F.col("vc").isNotNull(),
                  F.when(p_c == 0, F.when(p_t == 0, F.lit(0.0)).otherwise(zero))
                   .otherwise(F.abs(p_c - p_t)))
    out = tot.groupBy("rep", "test_build", "probe").agg(
        F.coalesce(F.sum(term), F.lit(0.0)).alias("relds"),
        (F.count(F.when(marker, F.col("vc"))) + F.count(F.when(marker, F.col("vt")))).alias("_sides"))
    return out.filter(F.col("_sides") == 2).select(
        "rep", F.col("test_build").alias("app_build_id"), "probe", "relds")


def measured(relds_long: DataFrame, cfg: RunConfig) -> DataFrame:
    """P20: the measured replicate (rep 0 by default; rep 1 reproduces the reference, Q1)."""
    return relds_long.filter(F.col("rep") == F.lit(cfg.measured_rep))


def bootstrap(relds_long: DataFrame, cfg: RunConfig) -> DataFrame:
    """P20: all other replicates (R rows per build and probe)."""
    return relds_long.filter(F.col("rep") != F.lit(cfg.measured_rep))


def relds_wide(relds_long: DataFrame, probes) -> DataFrame:
    """(app_build_id, rep, <probe>…) with one RelDS column per probe."""
    return (relds_long.groupBy("app_build_id", "rep").pivot("probe", list(probes))
            .agg(F.first("relds")))


def relds_quantiles(relds_boot: DataFrame, stats: DataFrame, cfg: RunConfig) -> DataFrame:
    """A7 + J3: exact bootstrap quantiles per (build, probe) with linear interpolation
    (the same rule as pandas and DuckDB quantile_cont), plus the build's profile and
    ping counts. A group holds R values, R being a run parameter."""
    qs = ", ".join(repr(float(q)) for q in cfg.quantiles)
    names = quantile_names("relds", cfg.quantiles)
    q = relds_boot.groupBy("app_build_id", "probe").agg(
        F.expr(f"percentile(relds, array({qs}))").alias("_q"))
    st = stats.select("app_build_id", "num_profiles", F.col("build_pings").alias("num_pings"))
    return q.join(st, "app_build_id").select(
        "probe", "app_build_id", "num_profiles", "num_pings",
        *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def regression_flags(quantiles: DataFrame, threshold: float) -> DataFrame:
    """thresh = relds_95 >= threshold."""
    return quantiles.withColumn("thresh", F.col("relds_95") >= F.lit(float(threshold)))


def alerts_by_build(flags: DataFrame) -> DataFrame:
    """Per build, the number of flagged probes and their names (sorted)."""
    f = flags.filter(F.col("thresh"))
    return f.groupBy("app_build_id").agg(
        F.count(F.lit(1)).alias("num_flagged"),
        F.array_join(F.array_sort(F.collect_list("probe")), ",").alias("flagged_probes"))
