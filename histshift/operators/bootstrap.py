"""Poisson bootstrap over client profiles.

Physical shape: replicates are expanded block by block. Every block of about ``rep_block``
replicates reads the materialised profile table (three columns) and, in the same stage, takes
the weights of up to ``REP_WIDTH`` replicates from hashes, as one array, ``inline``s the bins
once for all of them and pre-aggregates by (first replicate, build, probe, metric) with one sum
per replicate: a bin is looked up once, not once per replicate. The profile table is written
clustered by build (``by_build``), a large build over as many files as its size asks for:
a task holds the cells of a build or two, so its hash map stays small and what it shuffles
is about (distinct cells) x (files a build spans), not every cell of every build. (A run's profiles
are by build as they are made, ``profiles``; ``by_build`` is for those of a fold.) No profile
crosses a shuffle again. One marker element per (profile, replicate) adds sum(w) per
(rep, build) to the same aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histshift.config import RunConfig
from histshift.functions.poisson import (hash_key_start, hex_digits, poisson1_from_hex, poisson1_from_uniform,
                                         poisson1_thresholds, uniform32)

#: Replicates that are summed side by side; bounds the columns (and the code) of an aggregation.
REP_WIDTH = 24


def _rep_range(lo, hi):
    return F.explode(F.sequence(lo, hi)).alias("rep")


def bootstrap_weights(profile: DataFrame, cfg: RunConfig, reps=None) -> DataFrame:
    """(client_id, app_build_id, rep, w) for every replicate with w > 0,
    plus the other profile columns.

    Replicate 0 has weight 1 for every profile (the measured sample); replicates
    1..R draw Poisson(1) from the hash of (client, build, rep, seed). One weight per
    profile is shared by all its probes. ``w > 0`` is tested on the raw uniform so the
    hash is evaluated once per row (the weight's CASE chain is not repeated in the filter).
    """
    if reps is None:
        reps = profile.select("*", _rep_range(F.lit(0), F.lit(cfg.num_reps)))
    u = uniform32("client_id", "app_build_id", "rep", cfg.seed, cfg.uniform)
    kept = reps.withColumn("_u", u).filter(
        (F.col("rep") == 0) | (F.col("_u") >= F.lit(poisson1_thresholds()[0])))
    w = F.when(F.col("rep") == 0, F.lit(1)).otherwise(poisson1_from_uniform(F.col("_u")))
    return kept.withColumn("w", w).drop("_u")


def replicate_blocks(cfg: RunConfig, reps=None) -> list[tuple[int, int]]:
    """Ranges (first, last) of at most ``rep_block`` consecutive replicates, of even length."""
    wanted = sorted(set(range(cfg.num_reps + 1) if reps is None else reps))
    even = -(-len(wanted) // -(-len(wanted) // cfg.rep_block)) if wanted else 1
    out: list[tuple[int, int]] = []
    for r in wanted:
        if out and r == out[-1][1] + 1 and r - out[-1][0] < even:
            out[-1] = (out[-1][0], r)
        else:
            out.append((r, r))
    return out


def by_build(profile: DataFrame) -> DataFrame:
    """``profile`` dealt by build for writing. AQE merges small builds into one task and splits a
    large one by size (which no hash on the build could); without AQE the rows stay as they are.
    """
    adaptive = profile.sparkSession.conf.get("spark.sql.adaptive.enabled", "true") == "true"
    return profile.hint("rebalance", "app_build_id") if adaptive else profile


def _weight_arrays(prof: DataFrame, cfg: RunConfig, lo: int, hi: int, width: int) -> DataFrame:
    """``prof`` once per ``width`` replicates of lo..hi: ``rep_first`` and ``_w``, the weights of
    that replicate and its successors as doubles (NULL: 0). The same weights as
    ``bootstrap_weights``; the two steps evaluate every hash once."""
    first = F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(width))).alias("rep_first")
    reps = F.sequence("rep_first", F.least(F.col("rep_first") + F.lit(width - 1), F.lit(hi)))
    if cfg.uniform == "md5":
        draw, weight = (lambda r: hex_digits("_start", r, cfg.seed)), poisson1_from_hex
    else:
        draw = lambda r: uniform32("client_id", "app_build_id", r, cfg.seed, cfg.uniform)      # noqa: E731
        weight = lambda u: F.nullif(poisson1_from_uniform(u), F.lit(0))                        # noqa: E731
    drawn = F.transform(reps, lambda r: F.when(r != 0, draw(r)))            # replicate 0 draws nothing
    weights = F.transform(drawn, lambda u: F.when(u.isNull(), F.lit(1.0)).otherwise(weight(u).cast("double")))
    own = [c for c in prof.columns if c not in ("client_id", "app_build_id", "_start")]
    return prof.select("*", first).select("rep_first", *own, weights.alias("_w"))


def rep_cells(profile: DataFrame, cfg: RunConfig, reps=None) -> DataFrame:
    """The replicate cells, one row per (rep, app_build_id, probe, metric) with
    wsum = sum(w * p) over the build's profiles; rows with probe NULL carry n = sum(w). A cell
    that no profile of a replicate has is no row.

    ``reps`` restricts the replicates (the measured sample expands one). While they are
    aggregated, keys are numbers: probe (its position in the configured list, from 1) and
    metric share one long, and a build day of eight digits is an int; any other build id
    keeps its text. The marker element (cell 0) is prepended once per profile.
    """
    probes = F.array(*[F.lit(p) for p in cfg.probes])
    marker = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(1.0).alias("measure")))
    coded = F.transform("bins", lambda b: F.struct(
        (F.array_position(probes, b["probe"]) * F.lit(1 << 32) + b["metric"].cast("long")).alias("cell"),
        b["measure"].alias("measure")))
    digits = F.col("app_build_id").rlike("^[0-9]{8}$")
    prof = profile.select("client_id", "app_build_id", hash_key_start("client_id", "app_build_id").alias("_start"),
                          F.concat(marker, coded).alias("_cells"),
                          F.when(digits, F.col("app_build_id").cast("int")).alias("_day"),
                          F.when(~F.coalesce(digits, F.lit(False)), F.col("app_build_id")).alias("_text"))
    blocks = replicate_blocks(cfg, reps)
    longest = max(hi - lo + 1 for lo, hi in blocks)
    width = -(-longest // -(-longest // REP_WIDTH))
    parts = [_weight_arrays(prof, cfg, lo, hi, width).select("rep_first", "_day", "_text", "_w", F.inline("_cells"))
             for lo, hi in blocks]
    cells = reduce(lambda a, b: a.union(b), parts)
    agg = cells.groupBy("rep_first", "_day", "_text", "cell").agg(
        *[F.sum(F.get("_w", F.lit(i)) * F.col("measure")).alias(f"_s{i}") for i in range(width)])
    per_rep = F.array(*[F.struct((F.col("rep_first") + F.lit(i)).alias("rep"), F.col(f"_s{i}").alias("wsum"))
                        for i in range(width)])
    rows = agg.select("_day", "_text", "cell", F.inline(per_rep)).filter(F.col("wsum").isNotNull())
    place = F.shiftright(F.col("cell") + F.lit(1 << 31), 32)       # metrics may be negative
    data = F.col("cell") != 0
    return rows.select("rep", F.coalesce(F.lpad(F.col("_day").cast("string"), 8, "0"), "_text").alias("app_build_id"),
                       F.when(data, F.element_at(probes, place.cast("int"))).alias("probe"),
                       F.when(data, (F.col("cell") - place * F.lit(1 << 32)).cast("int")).alias("metric"), "wsum")


def rep_sizes(cells: DataFrame) -> DataFrame:
    """(rep, app_build_id, n): weighted number of profiles, bins or not (Q8)."""
    return cells.filter(F.col("probe").isNull()).select(
        "rep", "app_build_id", F.col("wsum").cast("bigint").alias("n"))


def rep_hists(cells: DataFrame) -> DataFrame:
    """replicate histograms normalised to unit density per (rep, build, probe)."""
    w = Window.partitionBy("rep", "app_build_id", "probe")
    return cells.filter(F.col("probe").isNotNull()).select(
        "rep", "app_build_id", "probe", "metric",
        F.try_divide(F.col("wsum"), F.sum("wsum").over(w)).alias("measure"))
