"""Runs and serving snapshots in one versioned store.

``publish_run`` adds the four outputs of a run, and folds it into the live snapshots, with one
commit: a reader sees all of it or nothing. The outputs of a run are parts (run date, build); a
live table has a part per build. A fold rewrites the parts of the builds that the run holds, and
no other: a live part remembers the newest run it was made from, so that a newer run meets the
live rows and its own, while a rerun or a late run of an older date rebuilds the part from the
runs that hold the build (the window bounds how many do).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from histshift.config import RunConfig
from histshift.functions.dates import build_date
from histshift.operators import ranks
from histshift.operators import snapshots as sn
from histshift.plans.comparison import run_comparison
from histshift.plans.daily_job import materialize, run_outputs
from histshift.session import job_folder
from histshift.sources.published import Change, Store, Version


@dataclass(frozen=True)
class Live:
    """How a live table follows from a run output: its keys, and columns derived at the end."""

    source: str
    keys: tuple[str, ...]
    derived: tuple[str, ...] = ()
    finish: Callable[[DataFrame], DataFrame] = lambda df: df


def live_tables(by_probe: bool = False) -> dict[str, Live]:
    hist_keys = sn.HISTS_KEYS_BY_PROBE if by_probe else sn.HISTS_KEYS
    return {"relds": Live("relds_csv", sn.RELDS_KEYS),
            "client_means": Live("client_means", sn.MEANS_KEYS, ("date",),
                                 lambda df: df.withColumn("date", build_date("app_build_id"))),
            "probe_hists": Live("probe_hists", hist_keys, ("cum_sum",), sn.hist_cdf)}


def _key(run_date: dt.date, build: str = "") -> str:
    return f"{run_date:%Y-%m-%d}/{build}"


def stage_run(store: Store, base: Version, outputs: dict[str, DataFrame], run_date: dt.date) -> dict[str, Change]:
    """K1-K4: the outputs of one run as parts (run date, build); a rerun replaces all of its date's."""
    changes = {}
    for name, df in outputs.items():
        c = store.stage(f"runs/{name}", df, prefix=_key(run_date))
        before = {k for k in base.parts(f"runs/{name}") if k.startswith(_key(run_date))}
        changes[f"runs/{name}"] = replace(c, gone=frozenset(before - set(c.parts)))
    return changes


def stage_fold(store: Store, version: Version, run_date: dt.date, tables: dict[str, Live]) -> dict[str, Change]:
    """U4: the live parts that the run of ``run_date`` touches, made anew from ``version``."""
    changes = {}
    day = f"{run_date:%Y-%m-%d}"
    for name, t in tables.items():
        runs, live = f"runs/{t.source}", version.parts(f"live/{name}")
        held: dict[str, list[str]] = {}                 # build -> its runs, by date
        for k in sorted(version.parts(runs)):
            held.setdefault(k.split("/", 1)[1], []).append(k)
        touched = {b for b, keys in held.items() if _key(run_date, b) in keys}
        touched |= {b for b, x in live.items() if day in x["runs"]}        # a rerun may have lost a build
        newer = {b for b in touched if b in live and live[b]["newest"] < day}
        anew = [k for b in touched - newer for k in held.get(b, [])]
        frames = [version.read(runs, [_key(run_date, b) for b in newer] + anew)]
        if newer:
            frames.append(version.read(f"live/{name}", newer).drop(*t.derived))
        rows = t.finish(sn.latest_wins(sn.union_loose(frames), t.keys))
        c = store.stage(f"live/{name}", rows)
        parts = {b: x | {"newest": max(k.split("/", 1)[0] for k in held[b]), "runs": [k.split("/", 1)[0] for k in held[b]]}
                 for b, x in c.parts.items()}
        changes[f"live/{name}"] = Change(c.schema, parts, frozenset(touched - set(parts)))
    return changes


def stage_ranks(store: Store, base: Version, folded: dict[str, Change]) -> dict[str, Change]:
    """The rank index of the live client means that a fold has made anew."""
    change = folded["live/client_means"]
    means = base.applied(folded).read("live/client_means", change.parts)
    probes = [f.name for f in means.schema if f.dataType.typeName() == "double"]
    return {name: replace(c, gone=frozenset(set(base.parts(name)) & (set(change.gone) | set(change.parts)) - set(c.parts)))
            for name, c in ranks.stage_index(store, means, probes).items()}


def publish_run(store: Store, outputs: dict[str, DataFrame], run_date: dt.date, by_probe: bool = False) -> Version:
    """The outputs of a run (all four, or some), the live snapshots folded from them and the rank
    index of the client means, visible together."""
    with job_folder(store.spark, "publish"):
        base = store.current()
        changes = stage_run(store, base, outputs, run_date)
        tables = {n: t for n, t in live_tables(by_probe).items() if t.source in outputs}
        folded = stage_fold(store, base.applied(changes), run_date, tables)
        changes |= folded
        if "client_means" in tables:
            changes |= stage_ranks(store, base, folded)
        return store.commit(base, changes)


def published_daily_job(spark: SparkSession, pings: DataFrame, cfg: RunConfig, root: str) -> Version:
    """E2 + E3 for ``cfg.final_date``: one comparison run, its four outputs and the snapshots."""
    with job_folder(spark, "published_job"):
        run = materialize(run_comparison(pings, cfg))
        return publish_run(Store(spark, root), run_outputs(run, cfg.final_date), cfg.final_date)


def read_runs(version: Version, name: str) -> DataFrame:
    """Every committed run of one output (``creation_date`` tells them apart)."""
    return version.read(f"runs/{name}")


def read_live(version: Version, name: str, builds=None) -> DataFrame:
    """A live snapshot, of ``builds`` only where given."""
    return version.read(f"live/{name}", builds)
