import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histshift.llm import jaccard_join as J
from histshift.session import settings
from tests.llm.fixtures import frame, words


def brute(rows, percent=80):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(((i, len(s), root(i) if i is not None else None) for i in sets for s in sets[i]), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_edge_rows_against_brute_force(spark):
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert rows_of(J.jaccard_components(df)) == brute(rows)


def test_empty_table(spark):
    assert J.jaccard_components(frame(spark, [])).count() == 0
    assert J.one_per_group(frame(spark, [])).columns == frame(spark, []).columns


def test_random_families_and_a_large_group(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for f in range(14):
        base = words(100 + f, rng.choice([6, 9, 20, 60, 200, 500]), 3000)
        for _ in range(9):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            rows.append((rng.randrange(10**6), " ".join(w[:rng.choice([len(w), max(1, len(w) - 3)])])))
    line = words(7, 14)
    rows += [(2 * 10**6 + k, " ".join(words(500 + k, 12, 9000) + line + line)) for k in range(60)]     # one frequent line
    monkeypatch.setattr(J, "SMALL_GROUP", 2)
    monkeypatch.setattr(J, "BLOCK", 4)
    assert rows_of(J.jaccard_components(frame(spark, rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("n", [5, 6, 8, 9, 10, 16, 31, 64, 100, 333, 1024])
def test_any_two_linked_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        pool = rng.integers(1, 2**63, 3 * n, dtype=np.uint64)
        changed = int(rng.integers(0, n // 4 + 2))
        a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:n - changed // 2], pool[n:n + changed - changed // 2]])
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 80 * (len(a) + len(b) - shared) or (len(a) == len(b) and (a == b).all()):
            continue
        whose, keys = J.signatures([a, b])
        assert set(keys[whose == 0].tolist()) & set(keys[whose == 1].tolist())
        assert J.hamming(J.parity_sketch(a), J.parity_sketch(b)) <= len(a) + len(b) - 2 * shared <= J.most_changes(len(a), len(b))


def test_a_part_that_a_third_of_all_sets_hold_is_split(spark):
    """Without broadcasts, the rows of a hot key meet its row in several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.files.maxPartitionBytes": "256k"}
    ids = spark.range(300_000)
    rows = ids.select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 90_000 + 100).alias("key"), F.xxhash64("id").alias("doc"))
    with settings(spark, conf):
        met = J._shared(J.write_table(rows, "skewed"))
        got = met.groupBy("key").agg(F.count("*").alias("n"), F.min("lo").alias("lo")).where("key = 7").first()
        tasks = [r.n for r in met.groupBy(F.spark_partition_id().alias("p"))
                 .agg(F.count(F.when(F.col("key") + F.col("lo") * 0 + F.col("doc") * 0 == 7, 1)).alias("n")).collect() if r.n]
    least = ids.where("id % 3 = 0").agg(F.min(F.xxhash64("id"))).first()[0]
    assert (got.n, got.lo) == (100_000, least)
    assert len(tasks) >= 3 and max(tasks) < 50_000


def survivors(rows):
    """Rows that stay, judged one by one: of each linked group that of the smallest (doc_id, place)."""
    rows = list(dict.fromkeys(rows))
    nodes = [(k, r[1]) for k, r in enumerate(rows) if r[0] is not None]
    group = {k: c for k, _, c in brute(nodes)}
    best = {}
    for k, _ in nodes:
        best[group[k]] = min(best.get(group[k], (rows[k][0], k)), (rows[k][0], k))
    return [r for k, r in enumerate(rows) if r[0] is None or best[group[k]][1] == k]


def test_one_per_group_keeps_columns_and_clean_rows(spark):
    df = frame(spark).withColumnRenamed("lang", "component_id")
    kept = J.one_per_group(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 13, 15, 17, 18, 19] and ids.count(None) == 2
    assert [r.text for r in kept.collect() if r.doc_id == 5] == [" ".join(words(6, 70))]      # the other 5 is a copy of 3


@pytest.mark.parametrize("shift", [0, 2 ** 63 - 4100])
def test_rows_of_one_id_are_judged_by_their_own_texts(spark, shift):
    rng = random.Random(9)
    bases = [words(900 + k, 40, 4000) for k in range(12)]
    rows = [(shift + rng.randrange(1, 30), " ".join(rng.choice(bases)[:rng.choice([40, 40, 39, 20])]), "x") for _ in range(120)]
    clean = [(shift + 5, " ".join(words(990, 30, 4000)), "x"), (shift + 4000, " ".join(words(991, 30, 4000)), "x")]
    rows += clean + [(shift + 5, None, "x"), (shift + 5, "", "x"), (shift + 5, "", "x"), (None, "free text of no one", "x"),
                     (None, "free text of no one", "y")]
    got = sorted(map(tuple, J.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()), key=repr)
    want = sorted(survivors(rows), key=repr)
    # which of several rows of the smallest id stays is open; texts of one group are told apart by their group only
    assert [r[0] for r in got] == [r[0] for r in want] and set(clean) <= set(got) and len(got) == len(want)
    a = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "some other clean text here now")]
    left = J.one_per_group(spark.createDataFrame(a, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left)) == [a[0], a[2]]
