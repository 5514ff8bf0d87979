"""Latest run wins, unions and cumulative histograms.

Daily runs append; a reader keeps, per key, the rows of the newest ``creation_date``
(ties kept, Q25 is avoided upstream by partition overwrite). The newest date per key is
an aggregate (partial, one row per key) joined back to the rows: a key holding a third
of all rows is split by AQE's skew join instead of landing in one window task, and the
join becomes a broadcast only when AQE measures the per-key table as small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histshift.session import write_table

# The keys under which each published table keeps its newest run.
RELDS_KEYS = ("app_build_id", "probe")
MEANS_KEYS = ("app_build_id",)
HISTS_KEYS = ("app_build_id", "metric")          # as written (Q16)
HISTS_KEYS_BY_PROBE = ("app_build_id", "probe")   # coherent variant


def latest_wins(df: DataFrame, keys, date_col: str = "creation_date") -> DataFrame:
    """Rows whose ``date_col`` equals the newest one of their key."""
    keys = list(keys)
    newest = df.groupBy(*keys).agg(F.max(date_col).alias("_newest"))
    newest = newest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_newest")
    cond = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    joined = df.join(newest, cond, "inner")
    return joined.filter(F.col(date_col) == F.col("_newest")).select(*df.columns)


def union_strict(frames) -> DataFrame:
    """Union all by column name; a column mismatch is an error."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_loose(frames) -> DataFrame:
    """Union all by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fold_latest(snapshot: DataFrame | None, new_run: DataFrame, keys,
                date_col: str = "creation_date") -> DataFrame:
    """U4: one incremental step: union the published snapshot with a new run and keep
    the newest rows. Folding runs one by one equals one latest_wins over their union."""
    both = new_run if snapshot is None else union_loose([snapshot, new_run])
    return latest_wins(both, keys, date_col)


def fold_runs(runs, keys, date_col: str = "creation_date") -> DataFrame:
    """U4: fold a sequence of runs one by one. Each step is written to the shared folder, so
    the plan of a step holds one snapshot and one run, however many were folded before."""
    snapshot = None
    for run in runs:
        snapshot = write_table(fold_latest(snapshot, run, keys, date_col), "fold")
    return snapshot


def newest_first(df: DataFrame) -> DataFrame:
    """O1: newest build first, for readers that show rows in order. Within a build rows go by a
    hash, so that the range partitioning of the sort can cut a build with a third of all rows."""
    plain = [F.col(c) for c, kind in df.dtypes if not kind.startswith("map") and c != "app_build_id"]
    return df.orderBy(F.desc("app_build_id"), F.xxhash64(*plain) if plain else F.lit(0))


def _cdf_window(keys=("app_build_id", "probe")):
    # metric orders the bins; the run date and measure make ties (Q16 mixes runs) deterministic
    return Window.partitionBy(*keys).orderBy("metric", "creation_date", "measure")


def hist_cdf(hists: DataFrame) -> DataFrame:
    """Running sum of measure per (build, probe) in metric order (not divided, Q20).
    A partition is one histogram, bounded by its number of bins."""
    w = _cdf_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hists.withColumn("cum_sum", F.sum("measure").over(w))


def hist_cdf_recomputed(hists: DataFrame) -> DataFrame:
    """Running sum divided by the histogram's total, after any range filter."""
    w = _cdf_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy("app_build_id", "probe")
    return hists.withColumn("cum_sum", F.try_divide(F.sum("measure").over(w),
                                                    F.sum("measure").over(tot)))
