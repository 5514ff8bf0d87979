"""Versioned stores: atomic commits, folds that touch their builds only, incremental runs."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from histshift.operators import snapshots as sn
from histshift.plans import catalog as C
from histshift.plans import publish as P
from histshift.plans.comparison import run_comparison
from histshift.plans.incremental import fold_pings, neighbours, window_outputs
from histshift.sources.published import CommitConflict, Store
from histshift.sources.readers import read_pings, read_snapshot
from histshift.sources.sinks import write_pings, write_snapshot
from tests.conftest import SF001, make_pings

KV = "app_build_id string, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def close(got, want):
    """Equal rows; doubles to 12 digits, since sums may run in another order."""
    def plain(rs):
        return sorted([tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in rs], key=repr)
    return plain(got.select(*want.columns).collect()) == plain(want.collect())


# ---------------------------------------------------------------- the store
def test_commits_replace_parts_and_old_versions_stay_readable(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.current().number == 0
    data = [("b1", 1), ("b1", 2), ("b/2 é%", 3), ("", 4), (None, 5)]
    one = s.publish({"t": spark.createDataFrame(data, KV)})
    assert rows(one.read("t")) == sorted(data, key=repr) and "b/2 é%" in one.parts("t")
    change = s.stage("t", spark.createDataFrame([("b1", 9)], KV))
    assert rows(s.current().read("t", ["b1"])) == [("b1", 1), ("b1", 2)]           # staged, not committed
    two = s.commit(one, {"t": change})
    assert rows(s.current().read("t", ["b1", "none"])) == [("b1", 9)]
    assert one.paths("t", ["b/2 é%"]) == two.paths("t", ["b/2 é%"])
    assert rows(one.read("t")) == sorted(data, key=repr)                           # a reader of the old version
    assert s.vacuum(keep=1) > 0 and rows(s.current().read("t")) == sorted([("b1", 9), *data[2:]], key=repr)
    assert not any(os.path.exists(p) for p in one.paths("t", ["b1"]))


def test_two_writers_on_one_version_conflict(spark, tmp_path):
    s, df = Store(spark, str(tmp_path)), spark.createDataFrame([("b", 1)], KV)
    base = s.current()
    s.commit(base, {"a": s.stage("a", df)})
    with pytest.raises(CommitConflict):
        s.commit(base, {"b": s.stage("b", df)})
    assert set(s.current().tables) == {"a"} and len(os.listdir(tmp_path / "_commits")) <= 2


def test_a_record_cut_short_is_passed_over(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.publish({"t": spark.createDataFrame([("b", 1)], KV)})
    (tmp_path / "_commits" / "000000000002.json").write_text('{"tables": {"t"')
    assert s.current().number == 1 and rows(s.current().read("t")) == [("b", 1)]


def test_parts_of_another_schema_cannot_join(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    v = s.publish({"t": spark.createDataFrame([("b", 1)], KV)})
    with pytest.raises(ValueError):
        s.commit(v, {"t": s.stage("t", spark.createDataFrame([("c", 1.5)], "app_build_id string, v double"))})


def test_snapshot_readers_keep_the_old_copy_until_the_new_one_is_whole(spark, tmp_path):
    path = str(tmp_path / "snap")
    write_snapshot(spark.createDataFrame([("b", 1)], KV), path)
    before = read_snapshot(spark, path)
    bad = spark.createDataFrame([("b", 2)], KV).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        write_snapshot(bad, path)
    assert rows(read_snapshot(spark, path)) == [("b", 1)]
    write_snapshot(spark.createDataFrame([("b", 3)], KV), path)
    assert rows(read_snapshot(spark, path)) == [("b", 3)] and rows(before) == [("b", 1)]
    plain = str(tmp_path / "plain")
    spark.createDataFrame([("b", 4)], KV).write.parquet(plain)
    assert rows(read_snapshot(spark, plain)) == [("b", 4)]


# ---------------------------------------------------------------- pruned pings
def test_a_window_reads_the_files_of_its_days(spark, tmp_path, cfg):
    data = [(f"c{i}", f"202401{d:02d}0930{i:02d}", {"h1": {1: 1}, "h2": None}) for d in range(1, 31) for i in range(3)]
    data += [("c", "20240115", {"h1": {1: 1}, "h2": None}), ("c", "2024", {"h1": None, "h2": None}), ("c", None, {"h1": None, "h2": None})]
    pings, path = make_pings(spark, data), str(tmp_path / "pings")
    write_pings(pings, path)
    stored = read_pings(spark, path)
    assert dict(stored.dtypes)["build_day"] == "string"
    from histshift.operators import profiles as pr
    from tests.test_plans import plan
    got = pr.client_build_pings(stored, cfg)
    text = plan(got)
    filters = text.split("PartitionFilters: ")[1].split("\n")[0]
    assert "build_day" in filters and "20240108" in filters and "20240115" in filters
    assert rows(got) == rows(pr.client_build_pings(pings, cfg))
    selected = pr.select_pings(stored, cfg).select(F.input_file_name().alias("f")).distinct().count()
    scan = pr.select_pings(stored, cfg)
    scan.collect()
    leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    read = leaf.metrics().apply("numFiles").value()
    files = sum(len([f for f in fs if f.endswith(".parquet")]) for _, _, fs in os.walk(path))
    assert selected <= read <= 8 < 30 < files + 1


# ---------------------------------------------------------------- folds of runs
H = "app_build_id string, probe string, metric int, measure double, creation_date date"
OUT = {"probe_hists": H, "relds_csv": "app_build_id string, probe string, relds_5 double, creation_date date",
       "client_means": "client_id string, app_build_id string, h1 double, creation_date date"}


def a_run(spark, d, builds, seed):
    rng = random.Random(seed)
    hists = [(b, p, m, rng.random(), d) for b in builds for p in ("h1", "h2") for m in range(rng.randint(1, 5))]
    relds = [(b, p, rng.random(), d) for b in builds[1:] for p in ("h1", "h2") if rng.random() < 0.8]
    means = [(f"c{i}", b, rng.random(), d) for b in builds for i in range(3)]
    return {n: spark.createDataFrame(r, OUT[n]) for n, r in (("probe_hists", hists), ("relds_csv", relds), ("client_means", means))}


def window(d, n=7):
    return [f"{d - dt.timedelta(days=k):%Y%m%d}" for k in range(n, 0, -1)]


def expected(runs, name, t):
    """The live table from all runs at once: a dict of run date -> outputs, reruns replaced."""
    return t.finish(sn.latest_wins(sn.union_strict([o[t.source] for o in runs.values()]), t.keys))


def check_live(store, runs):
    v = store.current()
    for name, t in P.live_tables().items():
        assert close(P.read_live(v, name), expected(runs, name, t)), name


def test_ten_folds_a_rerun_and_a_late_run_equal_the_batch(spark, tmp_path):
    store, runs = Store(spark, str(tmp_path)), {}
    first = dt.date(2024, 1, 15)
    for k in range(10):
        d = first + dt.timedelta(days=k)
        if k == 6:
            continue                                                    # comes late, below
        runs[d] = a_run(spark, d, window(d), k)
        before = store.current()
        v = P.publish_run(store, runs[d], d)
        for name in P.live_tables():
            kept = set(before.parts(f"live/{name}")) - set(window(d))
            assert before.paths(f"live/{name}", kept) == v.paths(f"live/{name}", kept)     # untouched builds keep their files
    check_live(store, runs)
    late = first + dt.timedelta(days=6)
    runs[late] = a_run(spark, late, window(late), 66)
    P.publish_run(store, runs[late], late)
    check_live(store, runs)
    last = first + dt.timedelta(days=9)
    runs[last] = a_run(spark, last, window(last)[:4], 99)                # a rerun that has lost builds
    P.publish_run(store, runs[last], last)
    check_live(store, runs)
    runs[last] = {n: df.limit(0) for n, df in runs[last].items()}       # and one without any row
    P.publish_run(store, runs[last], last)
    check_live(store, runs)


@pytest.mark.parametrize("lost", ["runs/client_means", "live/probe_hists", "commit"])
def test_a_failure_leaves_readers_on_the_last_whole_version(spark, tmp_path, lost):
    class Failing(Store):
        def stage(self, table, *args, **kw):
            if table == lost:
                raise InterruptedError(table)
            return super().stage(table, *args, **kw)

        def commit(self, *args, **kw):
            if lost == "commit":
                raise InterruptedError
            return super().commit(*args, **kw)

    d1, d2 = dt.date(2024, 1, 15), dt.date(2024, 1, 16)
    store, one, two = Store(spark, str(tmp_path)), a_run(spark, d1, window(d1), 1), a_run(spark, d2, window(d2), 2)
    P.publish_run(store, one, d1)
    state = {n: rows(P.read_live(store.current(), n)) for n in P.live_tables()}
    with pytest.raises(InterruptedError):
        P.publish_run(Failing(spark, str(tmp_path)), two, d2)
    v = store.current()
    assert v.number == 1 and {n: rows(P.read_live(v, n)) for n in P.live_tables()} == state
    assert all(close(P.read_runs(v, n), one[n]) for n in one)
    P.publish_run(store, two, d2)                                         # the job runs again
    check_live(store, {d1: one, d2: two})
    store.vacuum(keep=1)
    check_live(store, {d1: one, d2: two})


def test_the_published_job_equals_the_daily_job_and_its_snapshots(spark, tmp_path):
    p = C.pings(spark, SF001)
    for d in C.HISTORY[:2]:
        v = P.published_daily_job(spark, p, C.CFG.with_(final_date=d), str(tmp_path))
    outs = {d: o for d, o in zip(C.HISTORY[:2], C.history(spark, SF001))}
    for name, t in P.live_tables().items():
        assert close(C.out(P.read_live(v, name)), C.out(expected(outs, name, t))), name


# ---------------------------------------------------------------- incremental runs
OUTPUTS = ("relds", "relds_measured", "relds_quantiles", "build_hists", "client_means", "build_stats")


def check_window(store, pings, cfg):
    got, want = window_outputs(store.current(), cfg), run_comparison(pings, cfg)
    for name in OUTPUTS:
        assert close(getattr(got, name), getattr(want, name)), name


def some_pings(spark, days, seed, clients=12):
    rng = random.Random(seed)
    data = [("c0", None, {"h1": {1: 1}, "h2": None})]
    for d in days:
        for _ in range(40):
            hist = {m: rng.randint(0, 4) for m in rng.sample(range(0, 60, 5), rng.randint(0, 4))}
            if rng.random() < 0.05:
                hist[7] = None                                            # poisons that client's probe
            data.append((f"c{rng.randrange(clients)}", f"202401{d:02d}{rng.randrange(24):02d}0000",
                         {"h1": hist or None, "h2": {1: 1, 2: rng.randint(0, 3)}}))
    return make_pings(spark, data)


def test_folds_with_late_pings_reruns_and_new_builds_equal_the_batch(spark, tmp_path, cfg):
    store, batches = Store(spark, str(tmp_path)), {}

    def fold(name, pings):
        batches[name] = pings
        before = store.current()
        fold_pings(spark, store, pings, cfg, name)
        whole = sn.union_strict(list(batches.values()))
        check_window(store, whole, cfg)
        return before, store.current()

    fold("d8", some_pings(spark, [8], 1))
    fold("d10", some_pings(spark, [10], 2))
    fold("d11", some_pings(spark, [11, 10], 3))                           # with late pings of the 10th
    before, after = fold("d13", some_pings(spark, [13], 4))
    for table in ("cells", "stats", "means", "hists", "quantiles"):
        old = {b for b in before.parts(table) if b != "20240113"}
        assert before.paths(table, old) == after.paths(table, old)        # no other build was made again
    fold("d9", some_pings(spark, [9], 5))                                 # a build between two
    fold("d11", some_pings(spark, [11], 6))                               # the batch again, with other pings
    fold("d13", some_pings(spark, [13], 4).limit(0))                      # and one that is empty now
    assert "20240113" not in store.current().parts("stats")
    fold("none", some_pings(spark, [14], 7).limit(0))
    fold("d8", some_pings(spark, [8], 1).limit(0))                        # the oldest build goes
    assert "20240109" not in store.current().parts("quantiles")
    with pytest.raises(ValueError):
        fold_pings(spark, store, batches["d9"], cfg.with_(num_reps=5), "x")
    with pytest.raises(ValueError):
        window_outputs(store.current(), cfg.with_(seed=1))


def test_a_fold_that_fails_changes_nothing(spark, tmp_path, cfg):
    store = Store(spark, str(tmp_path))
    fold_pings(spark, store, some_pings(spark, [8, 9], 1), cfg, "a")
    state = store.current()
    bad = some_pings(spark, [9, 10], 2).withColumn("client_id", F.when(F.col("app_build_id") > "20240110", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        fold_pings(spark, store, bad, cfg, "b")
    assert store.current().tables == state.tables


def test_neighbours():
    assert neighbours(["a", "b", "c", "d"], {"b"}) == {"b": "a", "c": "b"}
    assert neighbours(["a", "b", "c", "d"], {"a"}) == {"b": "a"}
    assert neighbours(["a", "b", "c", "d"], {"d"}) == {"d": "c"}
    assert neighbours(["a"], {"a"}) == {} == neighbours([], {"x"})
    assert neighbours(["a", "c"], {"b"}) == {}


def test_a_fold_reads_one_day_of_arrivals_and_three_builds_of_cells(spark, tmp_path, cfg):
    """The pings' scan is pruned to the day; of the store only touched builds and neighbours are read."""
    path = str(tmp_path / "arrivals")
    days = range(8, 14)
    for d in days:
        some_pings(spark, [d], d).write.parquet(f"{path}/arrived={d}")
    store = Store(spark, str(tmp_path / "store"))
    arrivals = spark.read.parquet(path)
    for d in days:
        fold_pings(spark, store, arrivals.where(F.col("arrived") == d), cfg, f"d{d}")
    from tests.test_plans import plan
    text = plan(arrivals.where(F.col("arrived") == 9))
    assert "PartitionFilters: [isnotnull(arrived" in text
    reads = []

    from histshift.sources import published
    plain = published.Version.paths
    try:
        published.Version.paths = lambda self, t, keys=None: reads.append((t, None if keys is None else sorted(keys))) or plain(self, t, keys)
        fold_pings(spark, store, some_pings(spark, [10], 77), cfg, "late")
    finally:
        published.Version.paths = plain
    assert all(keys is not None for _, keys in reads)
    assert sorted({b for t, keys in reads if t == "cells" for b in keys}) == ["20240109", "20240110", "20240111"]
    assert {k.split("/")[1] for t, keys in reads if t == "bins" for k in keys} == {"20240110"}
