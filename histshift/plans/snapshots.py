"""Build the serving snapshots from the appended run outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from histshift.functions.dates import build_date
from histshift.operators import snapshots as sn
from histshift.sources import schemas
from histshift.sources.published import Store
from histshift.sources.readers import read_csv_parts, require


def relds_snapshot(relds_runs: DataFrame) -> DataFrame:
    """Newest run per (build, probe)."""
    return sn.latest_wins(relds_runs, sn.RELDS_KEYS)


def means_snapshot(means_runs: DataFrame) -> DataFrame:
    """Newest run per build, plus the build date."""
    return sn.latest_wins(means_runs, sn.MEANS_KEYS).withColumn("date", build_date("app_build_id"))


def hists_snapshot(hist_runs: DataFrame, by_probe: bool = False) -> DataFrame:
    """W3 + W5: newest run per (build, metric) as written (Q16), or per (build, probe);
    then the running sum per (build, probe) in metric order."""
    keys = sn.HISTS_KEYS_BY_PROBE if by_probe else sn.HISTS_KEYS
    return sn.hist_cdf(sn.latest_wins(hist_runs, keys))


def build_snapshots(spark: SparkSession, in_dir: str, out_dir: str, probes,
                    by_probe: bool = False) -> dict[str, DataFrame]:
    """Read the job's CSV outputs by column name (RelDS strictly; client means and histograms
    with NULL for what a run lacks), keep the newest runs, publish the three snapshots with one
    commit (readers see the old three until then), read back."""
    base = in_dir.rstrip("/")
    relds = read_csv_parts(spark, f"{base}/relds_csv", schemas.relds_quantiles_schema(), strict=True)
    means = read_csv_parts(spark, f"{base}/client_means", schemas.client_means_schema(probes))
    hists = require(read_csv_parts(spark, f"{base}/probe_hists", schemas.PROBE_HISTS), "measure")
    out = {"relds": relds_snapshot(relds), "client_means": means_snapshot(means),
           "probe_hists": hists_snapshot(hists, by_probe)}
    version = Store(spark, out_dir).publish(out)
    return {name: version.read(name) for name in out}
