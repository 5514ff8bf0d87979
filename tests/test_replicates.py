"""Replicates summed side by side, profiles without a window, pings kept for several runs."""

import pytest
from pyspark.sql import functions as F

from histshift.functions.poisson import (hash_key_start, hash_key_text, hex_digits, poisson1_from_hex,
                                         poisson1_from_uniform, poisson1_thresholds)
from histshift.operators import bootstrap as bs
from histshift.operators import profiles as pr
from histshift.plans import catalog as C
from tests.conftest import SF001, make_pings
from tests.test_plans import plan


def test_hex_weights_equal_integer_weights_at_every_threshold(spark):
    us = sorted({0, 2 ** 32 - 1} | {t + d for t in poisson1_thresholds() for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(u, f"{u:08x}" + tail) for u in us for tail in ("0" * 24, "f" * 24)], "u long, h string")
    got = rows.select(poisson1_from_uniform(F.col("u")).alias("a"), F.coalesce(poisson1_from_hex(F.col("h")), F.lit(0)).alias("b"))
    assert all(r.a == r.b for r in got.collect())


@pytest.mark.parametrize("seed", [0, 5])
def test_hashed_text_is_the_same_in_two_parts(spark, seed):
    rows = spark.createDataFrame([(c, b) for c in ("a", "", "é", None) for b in ("20240101", "", None)], "c string, b string")
    same = F.md5(hash_key_text(F.col("c"), F.col("b"), F.lit(12), seed)) == hex_digits(hash_key_start("c", "b"), F.lit(12), seed)
    assert all(r[0] for r in rows.select(same).collect())


@pytest.mark.parametrize("method,reps,block", [("md5", None, 64), ("md5", None, 7), ("xxhash64", None, 64), ("md5", [2, 3, 9], 64), ("md5", [0], 64)])
def test_cells_are_the_weighted_sums_of_single_replicates(spark, cfg, method, reps, block):
    rows = [(c, b, {"h1": {1: i + 1, 5: 2}, "h2": {i: 1} if i % 2 else None}) for i, c in enumerate("abcdefg")
            for b in ("20240110093000", "20240111093000")]
    cfg = cfg.with_(num_reps=60, uniform=method, rep_block=block)
    prof = pr.profiles(make_pings(spark, rows), cfg)
    wanted = range(61) if reps is None else reps
    w = bs.bootstrap_weights(prof, cfg).filter(F.col("rep").isin(list(wanted)))
    cells = w.select("rep", "app_build_id", "w", F.inline("bins")).groupBy("rep", "app_build_id", "probe", "metric").agg(
        F.sum(F.col("w") * F.col("measure")).alias("wsum"))
    sizes = w.groupBy("rep", "app_build_id").agg(F.sum("w").cast("double").alias("wsum"))
    want = {tuple(r)[:4]: r.wsum for r in cells.collect()} | {(r.rep, r.app_build_id, None, None): r.wsum for r in sizes.collect()}
    got = bs.rep_cells(prof, cfg, reps).collect()
    assert len(got) == len(want) and {tuple(r)[:4]: pytest.approx(r.wsum) for r in got} == want


def test_a_bin_is_aggregated_once_for_all_replicates(spark):
    """The aggregated rows are a profile's bins, not a profile's bins times its replicates."""
    p = plan(C.run(spark, SF001).cells, "simple")
    assert p.count("Exchange hashpartitioning(rep_first") == 1
    fewest = p.count("partial_sum(")
    assert fewest == C.CFG.num_reps + 1


def test_profiles_need_no_window_and_no_sort_of_their_own(spark, cfg):
    p = plan(pr.profiles(make_pings(spark, [("a", "20240110093000", {"h1": {1: 1}})]), cfg), "simple")
    assert "Window" not in p


def test_profiles_by_hand(spark, cfg):
    """Poisoned, all-zero and missing probes; densities and means of the others."""
    rows = [("a", "20240110093000", {"h1": {1: 1, 4: 2}, "h2": {2: None, 3: 1}}),
            ("a", "20240110103000", {"h1": {4: 1}, "h2": {3: 1}}),
            ("b", "20240110093000", {"h1": {0: 0}, "h2": None}),
            ("c", "20240110093000", {"h1": None, "h2": {-5: 1, 5: 3}})]
    got = {r.client_id: (r.num_client_pings, sorted(tuple(b) for b in r.bins), tuple(r.means))
           for r in pr.profiles(make_pings(spark, rows), cfg).collect()}
    assert got == {"a": (2, [("h1", 1, 0.25), ("h1", 4, 0.75)], (3.25, None)), "b": (1, [], (None, None)),
                   "c": (1, [("h2", -5, 0.25), ("h2", 5, 0.75)], (None, 2.5))}
    est = {r.client_id: tuple(r.means) for r in pr.profiles(make_pings(spark, rows), cfg.with_(estimator=True)).collect()}
    assert est["b"] == (0.0, None) and est["a"] == ((1.5 + 4 * 3.5) / 5, None)


def test_lineitem_pings_count_bins_of_repeated_and_unlike_lines(spark, tmp_path):
    import datetime as dt

    from histshift.sources.adapters import lineitem_pings
    day = dt.datetime(2000, 3, 5)
    lines = [(1, 7.0, 5100.0, 0.01, 0.02, day), (1, 7.0, 5100.0, 0.01, 0.02, day), (2, 8.0, 100.0, 0.03, 0.02, day),
             (3, 1.0, 100.0, 0.03, 0.02, day)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                                 "l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.client_id: (r.hist_quantity, r.hist_price, r.hist_discount, r.hist_tax)
           for r in lineitem_pings(spark, str(tmp_path)).collect()}
    assert got == {"10": ({5: 3}, {5000: 2, 0: 1}, {1: 2, 3: 1}, {2: 3}), "11": ({0: 1}, {0: 1}, {3: 1}, {2: 1})}


@pytest.mark.parametrize("name", ["latest_incremental", "live_folded", "daily_job_outputs"])
def test_runs_of_one_query_share_one_ping_table(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(C, "events_pings", lambda s, sf, f=C.events_pings: made.append(f(s, sf)) or made[-1])
    read = []
    monkeypatch.setattr(C, "run_comparison", lambda p, cfg, f=C.run_comparison: read.append(p) or f(p, cfg))
    monkeypatch.setattr(C, "daily_job", lambda s, p, cfg, path, f=C.daily_job: read.append(p) or f(s, p, cfg, path))
    C.QUERIES[name](spark, SF001)
    assert len(made) == 1 and len(read) >= 6
    assert not any("events.parquet" in f for p in read for f in p.inputFiles())


def exchanges(df) -> list[str]:
    return [line.strip(" +-:") for line in plan(df, "simple").splitlines() if "Exchange" in line]


def test_pings_are_shuffled_once_and_whole_before_their_bins_are_exploded(spark, cfg):
    """A profile needs one shuffle: of pings, not of bins, by ranges of (build, client)."""
    pings = make_pings(spark, [("a", "20240110093000", {"h1": {1: 1, 2: 1}, "h2": {3: 1}})])
    prof = pr.profiles(pings, cfg)
    moved = exchanges(prof)
    assert len(moved) == 1 and "Exchange rangepartitioning(app_build_id" in moved[0]
    p = plan(prof, "simple")
    assert "Generate" not in p[p.index(moved[0]):]


def test_a_written_profile_is_dealt_once(spark, cfg, monkeypatch):
    from histshift.plans import comparison
    written = {}
    monkeypatch.setattr(comparison, "write_table", lambda df, name: written.setdefault(name, df))
    comparison.run_comparison(make_pings(spark, [("a", "20240110093000", {"h1": {1: 1}})]), cfg).profile
    assert len(exchanges(written["profile"])) == 1


def test_a_written_profile_is_sorted_once_and_needs_no_hash_map(spark, cfg):
    from histshift.session import COLLECTING, settings
    with settings(spark, COLLECTING):
        p = plan(pr.profiles(make_pings(spark, [("a", "20240110093000", {"h1": {1: 1}})]), cfg), "simple")
    assert "HashAggregate" not in p and p.count(" Sort [") == 1


def test_lineitem_lines_are_dealt_to_pings_once(spark):
    """Beside what the join needs, lines cross one shuffle, as bins."""
    from histshift.sources.adapters import lineitem_pings
    moved = [e for e in exchanges(lineitem_pings(spark, SF001)) if "hashpartitioning(" in e]
    assert len([e for e in moved if "orderkey" not in e]) == 1 and any("hashpartitioning(cust" in e for e in moved)


def test_dealt_profiles_equal_profiles_of_summed_bins(spark, cfg):
    """Repeated pings, poisoned, empty, zero and missing maps, negative bins and clients without an id, on
    several partitions."""
    from histshift.session import COLLECTING, settings
    maps = [{1: 1, -4: 2}, {}, None, {1: 0}, {7: None, 1: 3}, {-(2 ** 31): 5, 2 ** 31 - 1: 2 ** 40}]
    rows = [(c, f"202401{10 + d}09300{k}", {"h1": maps[(i + k) % 6], "h2": maps[(i + 2 * d) % 6]})
            for i, c in enumerate(["a", "b", "", "é", None, "f"]) for d in range(4) for k in range(3) if (i + d + k) % 5]
    pings = make_pings(spark, rows + rows[::3]).repartition(5)

    def found(prof):
        return sorted((repr((r.client_id, r.app_build_id, r.num_client_pings, tuple(r.means))), sorted(map(repr, r.bins)))
                      for r in prof.collect())
    for c in (cfg, cfg.with_(estimator=True), cfg.with_(partitions=3)):
        want = found(pr.profiles_of(pr.client_bins(pr.select_pings(pings, c), c), c))
        assert len(want) > 15 and found(pr.profiles(pings, c)) == want
        with settings(spark, COLLECTING):
            assert found(pr.profiles(pings, c)) == want
