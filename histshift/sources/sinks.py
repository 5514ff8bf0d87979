"""Sinks (K1-K5). Every run writes one ``creation_date`` directory and overwrites exactly
that one: a new date appends, a same-day rerun replaces its own rows, also when it has
none (Q25). All writers run on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.functions.dates import BUILD_DAY, build_day
from histshift.sources.published import Store

#: The table that a store with one snapshot holds.
SNAPSHOT = "snapshot"


def write_run(df: DataFrame, path: str, run_date, fmt: str = "csv", date_col: str = "creation_date") -> None:
    """K1-K4: write one run's rows under ``path/<date_col>=<run date>/``, replacing them."""
    w = df.drop(date_col).write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(f"{path.rstrip('/')}/{date_col}={run_date:%Y-%m-%d}")


def write_snapshot(df: DataFrame, path: str) -> None:
    """K5: publish a serving snapshot in place of the previous one, which readers keep until the
    new one is whole. A part per build, a large build over several files; no global sort."""
    Store(df.sparkSession, path).publish({SNAPSHOT: df})


def write_pings(pings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A ping table partitioned by build day (the first 8 characters of the id), so that a
    window reads its days only. A hot day is split by size, small days share a task."""
    out = pings.withColumn(BUILD_DAY, build_day())
    if pings.sparkSession.conf.get("spark.sql.adaptive.enabled", "true") == "true":
        out = out.hint("rebalance", BUILD_DAY)
    out.write.mode(mode).partitionBy(BUILD_DAY).parquet(path)


def write_json_hists(hists: DataFrame, path: str) -> None:
    """One JSON record per (build, probe) with its bins as an object. A record
    holds one histogram, bounded by the probe's number of bins."""
    recs = hists.groupBy("app_build_id", "probe").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("metric").cast("string"), "measure")))
         .alias("hist"))
    recs.write.mode("overwrite").json(path)


def with_run_date(df: DataFrame, run_date) -> DataFrame:
    """Attach the run date (an argument, never the clock)."""
    return df.withColumn("creation_date", F.lit(run_date).cast("date"))
