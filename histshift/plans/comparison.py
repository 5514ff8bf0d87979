"""One comparison run as DataFrames.

pings -> one shuffle by (build, client) -> profiles (written once, clustered by build) -> replicate blocks, each read from the profile table and
pre-aggregated -> shuffle by (rep, build, probe, metric) -> join with the calendar -> one
group per (rep, comparison, probe) -> RelDS -> percentile. Nothing is collected to the
driver; every output is a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from histshift.config import RunConfig
from histshift.operators import bootstrap as bs
from histshift.operators import profiles as pr
from histshift.operators import relds as rd
from histshift.session import COLLECTING, settings, write_table


@dataclass
class RunResult:
    """Outputs of one run. They are lazy, except that the first use of ``profile`` or
    ``build_stats`` runs the job that writes it.

    With ``materialize`` the profile table is written once, clustered by build, as parquet under the shared
    folder (``spark.checkpoint.dir``), on first use: the replicate expansion, the build
    stats and the client means all read it, so the ping table is scanned once per run
    (without it each consumer prunes the profile differently and the scan would be
    repeated), and a lost executor sends the run back to that table, not to the scan.
    """

    pings: DataFrame
    cfg: RunConfig
    materialize: bool = True

    @cached_property
    def selected(self) -> DataFrame:
        return pr.select_pings(self.pings, self.cfg)

    @cached_property
    def profile(self) -> DataFrame:
        prof = pr.profiles(self.pings, self.cfg)
        if not self.materialize:
            return prof
        with settings(prof.sparkSession, COLLECTING):
            return write_table(prof, "profile")

    @cached_property
    def build_stats(self) -> DataFrame:
        """One row per build (at most num_days + 1): materialised with the profile so
        the calendar, the quantile join and the pairs read it instead of rescanning
        the profile table."""
        stats = pr.build_stats(self.profile)
        return write_table(stats, "build_stats") if self.materialize else stats

    @cached_property
    def client_means(self) -> DataFrame:
        return pr.client_means(self.profile, self.cfg.probes)

    @cached_property
    def calendar(self) -> DataFrame:
        return rd.build_calendar(self.build_stats)

    @cached_property
    def cells(self) -> DataFrame:
        return bs.rep_cells(self.profile, self.cfg)

    @cached_property
    def measured_cells(self) -> DataFrame:
        """Cells of the measured replicate alone: one replicate is expanded, not R + 1."""
        return bs.rep_cells(self.profile, self.cfg, [self.cfg.measured_rep])

    @cached_property
    def bootstrap_cells(self) -> DataFrame:
        return bs.rep_cells(self.profile, self.cfg,
                            [r for r in range(self.cfg.num_reps + 1) if r != self.cfg.measured_rep])

    @cached_property
    def rep_sizes(self) -> DataFrame:
        return bs.rep_sizes(self.cells)

    @cached_property
    def rep_hists(self) -> DataFrame:
        return bs.rep_hists(self.cells)

    @cached_property
    def relds(self) -> DataFrame:
        return rd.relds(self.cells, self.calendar, self.cfg)

    @cached_property
    def relds_measured(self) -> DataFrame:
        return rd.measured(rd.relds(self.measured_cells, self.calendar, self.cfg), self.cfg)

    @cached_property
    def relds_bootstrap(self) -> DataFrame:
        return rd.bootstrap(rd.relds(self.bootstrap_cells, self.calendar, self.cfg), self.cfg)

    @cached_property
    def build_hists(self) -> DataFrame:
        """the measured replicate's build histograms (app_build_id, probe, metric, measure)."""
        return bs.rep_hists(self.measured_cells).drop("rep")

    @cached_property
    def relds_quantiles(self) -> DataFrame:
        return rd.relds_quantiles(self.relds_bootstrap, self.build_stats, self.cfg)

    def comparison_pairs(self) -> DataFrame:
        return rd.comparison_pairs(self.rep_sizes, self.calendar, self.cfg)


def run_comparison(pings: DataFrame, cfg: RunConfig, materialize: bool = True) -> RunResult:
    """Outputs of one run: bootstrap and measured RelDS, build histograms, client
    means, build stats and RelDS quantiles (see RunResult for ``materialize``)."""
    return RunResult(pings, cfg, materialize)
