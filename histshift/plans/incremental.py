"""Incremental comparison run (E1, E2): a day of pings is folded in, a window is read out.

A versioned store (``sources.published``) keeps, per build, what a comparison run derives:

* ``bins``: summed bins and ping counts of each batch of pings, parts (batch, build). Bins add up,
  so pings that arrive late, or a batch that is submitted again, change their own part only;
* ``cells``: the replicate cells, ``stats``, ``means`` and ``hists``: parts by build;
* ``relds`` and ``quantiles``: parts by test build.

``fold_pings`` reads the pings it is given, and of the store the bins of the builds they touch and
the cells of these builds' neighbours: profiles and cells are made for touched builds, and only
the comparisons that a touched build takes part in (its own, and the next build's) are computed
again. Weights are a pure function of client, build and replicate, so what is kept equals what a
batch run would compute; ``window_outputs`` gives the outputs of a batch run over any window.
All tables change with one commit.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histshift.config import RunConfig
from histshift.functions.dates import window_bounds
from histshift.operators import bootstrap as bs
from histshift.operators import profiles as pr
from histshift.operators import relds as rd
from histshift.session import COLLECTING, job_folder, settings as session_settings, write_table
from histshift.sources.published import Change, Store, Version

CALENDAR = "app_build_id string, control_build string"
#: Settings that every fold of a store has to share, since kept rows depend on them.
SHARED = ("probes", "app", "channel", "num_reps", "seed", "sample", "sample_cut", "debug", "estimator", "measured_rep",
          "zero_val", "uniform", "quantiles")


def settings(cfg: RunConfig) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in dataclasses.asdict(cfg).items() if k in SHARED}


def _build(key: str) -> str:
    return key.split("/", 1)[1]


def _without(change: Change, version: Version, table: str, builds) -> Change:
    """``change``, which also drops the old parts of ``builds`` that it does not replace."""
    return dataclasses.replace(change, gone=frozenset(set(builds) & set(version.parts(table)) - set(change.parts)))


def stage_bins(store: Store, base: Version, pings: DataFrame, cfg: RunConfig, batch: str) -> tuple[dict[str, Change], set[str]]:
    """The bins of one batch as parts (batch, build), in place of an earlier submission of the same
    batch; and the builds that either of them holds."""
    if "/" in batch:
        raise ValueError("a batch name holds no slash")
    pr.check_probes(pings, cfg.probes)
    bins = pr.client_bins(pings.filter(F.col("app_build_id").isNotNull() & pr.population_predicate(cfg)), cfg)
    new = store.stage("bins", bins, prefix=f"{batch}/")
    before = {k for k in base.parts("bins") if k.startswith(f"{batch}/")}
    change = dataclasses.replace(new, gone=frozenset(before - set(new.parts)))
    return {"bins": change}, {_build(k) for k in before | set(new.parts)}


def neighbours(builds: list[str], touched: set[str]) -> dict[str, str]:
    """Test build -> control build of the comparisons that ``touched`` builds take part in;
    ``builds`` are all builds, in order."""
    pairs = dict(zip(builds[1:], builds))
    return {t: c for t, c in pairs.items() if t in touched or c in touched}


def fold_pings(spark: SparkSession, store: Store, pings: DataFrame, cfg: RunConfig, batch: str) -> Version:
    """Fold one batch of pings (a day's submissions, with whatever is late among them) into ``store``.

    The batch may hold any builds; the window of ``cfg`` plays no part. Folding a batch again, under
    its name, replaces it.
    """
    base = store.current()
    if base.meta.get("settings", settings(cfg)) != settings(cfg):
        raise ValueError(f"the store was built with {base.meta['settings']}")
    with job_folder(spark, "fold"):
        changes, touched = stage_bins(store, base, pings, cfg, batch)
        if not touched:
            return store.commit(base, changes, {"settings": settings(cfg)})
        v = base.applied(changes)
        kept = [k for k in v.parts("bins") if _build(k) in touched]
        with session_settings(spark, COLLECTING):
            profile = write_table(bs.by_build(pr.profiles_of(pr.merged_bins(v.read("bins", kept)), cfg)), "profile")
        stats = write_table(pr.build_stats(profile), "stats")
        made = {"stats": store.stage("stats", stats),
                "means": store.stage("means", pr.client_means(profile, cfg.probes)),
                "cells": store.stage("cells", bs.rep_cells(profile, cfg))}
        changes |= {t: _without(c, base, t, touched) for t, c in made.items()}
        v = base.applied(changes)
        measured = v.read("cells", touched).filter(f"rep = {int(cfg.measured_rep)}")
        changes["hists"] = _without(store.stage("hists", bs.rep_hists(measured).drop("rep")), base, "hists", touched)

        builds = sorted(v.parts("stats"))
        pairs = neighbours(builds, touched)
        calendar = spark.createDataFrame(list(pairs.items()), CALENDAR)        # a row per touched comparison
        relds = write_table(rd.relds(v.read("cells", set(pairs) | set(pairs.values())), calendar, cfg), "relds")
        changes["relds"] = store.stage("relds", relds)
        tests = v.read("stats", pairs)
        changes["quantiles"] = store.stage("quantiles", rd.relds_quantiles(rd.bootstrap(relds, cfg), tests, cfg))
        for t in ("relds", "quantiles"):
            changes[t] = _without(changes[t], base, t, touched | set(pairs) | set(builds[:1]))
        return store.commit(base, changes, {"settings": settings(cfg)})


@dataclass(frozen=True)
class WindowOutputs:
    """The outputs of a batch run over a window, read from the store's kept parts."""

    version: Version
    cfg: RunConfig

    @property
    def builds(self) -> list[str]:
        """Build days of the window. As in a batch run its last day is left out (its ids are longer
        than the bound) unless ``inclusive_end``; ids of a bare day are treated alike."""
        start, end = window_bounds(self.cfg.final_date, self.cfg.num_days)
        return [b for b in sorted(self.version.parts("stats"))
                if start <= b and (b <= end if self.cfg.inclusive_end else b < end)]

    def _tests(self, table: str) -> DataFrame:
        return self.version.read(table, self.builds[1:])        # the oldest build is never a test

    @property
    def build_stats(self) -> DataFrame:
        return self.version.read("stats", self.builds)

    @property
    def client_means(self) -> DataFrame:
        return self.version.read("means", self.builds)

    @property
    def build_hists(self) -> DataFrame:
        return self.version.read("hists", self.builds)

    @property
    def relds(self) -> DataFrame:
        return self._tests("relds")

    @property
    def relds_measured(self) -> DataFrame:
        return rd.measured(self.relds, self.cfg)

    @property
    def relds_quantiles(self) -> DataFrame:
        return self._tests("quantiles")


def window_outputs(version: Version, cfg: RunConfig) -> WindowOutputs:
    if version.meta.get("settings") not in (None, settings(cfg)):
        raise ValueError(f"the store was built with {version.meta['settings']}")
    return WindowOutputs(version, cfg)
