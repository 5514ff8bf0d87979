import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from histshift.llm import mixing as M
from histshift.llm.prefix import prefix_sums
from histshift.llm.queries import ORACLE, QUERIES
from histshift.testing.compare import compare
from tests.conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, text string, taken string"


def targets(sizes, weights, total, epochs):
    """Share and reshare, source by source, in fractions."""
    full, out = set(), {}
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        out = {s: Fraction(epochs * sizes[s]) for s in full}
        weight = sum(weights[s] for s in open_)
        out |= {s: left * weights[s] / weight for s in open_}
        over = {s for s in open_ if out[s] > epochs * sizes[s]}
        if not over:
            return out
        full |= over


def brute(rows, weights=(3, 1, 2), share=Fraction(3, 2), epochs=2, seed=12):
    size = [len(WORD.findall(t or "")) for _, _, t, *_ in rows]
    total = defaultdict(int)
    for (_, s, *_), n in zip(rows, size):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal = targets(total, w, sum(total.values()) * share, epochs)

    def key(r):
        return hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15]

    out = []
    for s in order:
        own = sorted(((key(r), r[0] is not None, r[0] or 0, n) for r, n in zip(rows, size) if r[1] == s))
        budget, before = int(goal[s]), 0
        whole, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for _, known, i, n in own:
            out.append((i if known else None, n, total[s], float(goal[s]), whole * n + min(n, max(0, rest - before))))
            before += n
    return sorted(out, key=repr)


def made(n=400):
    rng = random.Random(4)
    sources = ["big"] * 6 + ["a", "b", "é", "\U0001d54f", "￮", None]
    rows = [(i, rng.choice(sources), " \t".join("w" * rng.randint(1, 9) for _ in range(rng.randrange(0, 60))), "x") for i in range(n)]
    return rows + [(900, "empty", None, "x"), (901, "empty", " \n", "x"), (902, "tiny", "one", "x"), (None, "a", "no id here", "x"),
                   (903, "big", "long " * 20_000, "x")]


def got(df):
    return sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in df.collect()), key=repr)


@pytest.mark.parametrize("share,epochs,weights", [(Fraction(3, 2), 2, (3, 1, 2)), (Fraction(1, 7), 1, (1,)), (Fraction(9, 2), 3, (5, 1)),
                                                  (Fraction(2), 2, (3, 1, 2))])
def test_against_the_plain_version(spark, share, epochs, weights):
    rows = made()
    plan = M.plan_mix(spark.createDataFrame(rows, SCHEMA), weights, share, epochs)
    assert got(plan) == brute(rows, weights, share, epochs)


def test_repeated_rows_and_ids_are_rows_of_their_own(spark):
    rows = [(1, "a", "x y z", "t")] * 5 + [(1, "a", "other text of it", "t"), (2, "b", "p q", "t"), (2, "c", "p q", "t")]
    df = M.plan_mix(spark.createDataFrame(rows, SCHEMA))
    found = df.collect()
    assert len(found) == len(rows) and sum(r.size for r in found) == 15 + 4 + 4
    for s in "abc":
        own = [r for r in found if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target) and all(r.taken <= 2 * r.size for r in own)
    mixed = Counter()
    for r in M.mixed_texts(spark.createDataFrame(rows, SCHEMA), df).collect():
        mixed[r.source] += len(WORD.findall(r.text))
    assert mixed == Counter({s: sum(r.taken for r in found if r.source == s) for s in "abc"})


def test_mixed_texts_hold_the_taken_words(spark):
    rows = made(120)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = M.plan_mix(df)
    taken = {r.doc_id: r.taken for r in plan.collect()}
    texts = {r[0]: r[2] for r in rows}
    words = defaultdict(list)
    for r in sorted(M.mixed_texts(df, plan).collect(), key=lambda r: r.epoch):
        words[r.doc_id].append(r.text)
    for i, n in taken.items():
        whole = WORD.findall(texts[i] or "")
        want = (whole * 3)[:n]
        assert [w for t in words[i] for w in WORD.findall(t)] == want
        assert all(t == texts[i] for t in words[i][:-1])


def test_reruns_and_partitionings_agree(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    first = got(M.plan_mix(df))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        assert got(M.plan_mix(df.repartition(7).orderBy(F.rand(3)))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_prefix_sums_with_null_groups_and_a_hot_one(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["h", "h", "h", None, "a", ""]), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    found = prefix_sums(df, ["g"], ["o"], "v", "before", "test").collect()
    sums, want = Counter(), {}
    for g, o, v in rows:
        want[o] = sums[g]
        sums[g] += v
    assert {r.o: r.before for r in found} == want


def test_empty_table_blank_texts_and_oracle(spark):
    assert M.mix_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = M.mix_digest(spark.createDataFrame([(1, "a", None, "x"), (2, None, " ", "x")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in blank) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    r = compare(QUERIES["op12_source_mix"](spark, SF001), ORACLE["op12_source_mix"], SF001)
    assert r["columns_match"] and r["values_match"], r
