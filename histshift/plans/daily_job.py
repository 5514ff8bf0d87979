"""The daily job: one comparison run, its summaries, and the four sinks.

The profile table and the replicate cells feed several outputs; they are written under the
shared folder (``spark.checkpoint.dir``) so each sink reads them instead of recomputing the
replicate expansion, and a lost executor does not send the job back to the ping scan. The
job removes these intermediates when its outputs are written.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from histshift.config import RunConfig
from histshift.operators import relds as rd
from histshift.plans.comparison import RunResult, run_comparison
from histshift.session import job_folder, write_table
from histshift.sources.sinks import with_run_date, write_run

OUTPUTS = ("relds_csv", "relds_measured", "probe_hists", "client_means")


def materialize(run: RunResult) -> RunResult:
    """Cut the lineage of the shared intermediates (the run materialises its profile; the
    measured cells feed the measured RelDS and the build histograms)."""
    run.__dict__["measured_cells"] = write_table(run.measured_cells, "measured_cells")
    return run


def run_outputs(run: RunResult, run_date: dt.date) -> dict[str, DataFrame]:
    cfg = run.cfg
    return {
        "relds_csv": with_run_date(run.relds_quantiles, run_date),
        "relds_measured": with_run_date(rd.relds_wide(run.relds_measured, cfg.probes), run_date),
        "probe_hists": with_run_date(run.build_hists, run_date),
        "client_means": with_run_date(run.client_means, run_date),
    }


def daily_job(spark: SparkSession, pings: DataFrame, cfg: RunConfig, out_dir: str,
              checkpoint: bool = True) -> dict[str, str]:
    """Run for ``cfg.final_date`` and write every output; returns the output paths."""
    paths = {}
    with job_folder(spark, "daily_job"):
        run = run_comparison(pings, cfg)
        if checkpoint:
            materialize(run)
        for name, df in run_outputs(run, cfg.final_date).items():
            path = f"{out_dir.rstrip('/')}/{name}"
            write_run(df, path, cfg.final_date)
            paths[name] = path
    return paths
