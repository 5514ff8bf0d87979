import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histshift.llm import gnat as G
from histshift.llm import vectors as V
from histshift.llm.common import table
from histshift.llm.queries import ORACLE, QUERIES
from histshift.testing.compare import compare
from tests.conftest import SF001, SF01

SCHEMA = "vec_id long, embedding array<double>, label int, rank int"


def product(a, b):
    s = sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))
    return min(max(s, -(1 << 63)), (1 << 63) - 1)


def clean(rows):
    out = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        out[i] = min(out.get(i, (label, v)), (label, v))
    return out


def brute(rows, every=50):
    rows = clean(rows)
    out = []
    for a, (label, v) in rows.items():
        if a % every:
            continue
        score = {i: product(v, w) for i, (_, w) in rows.items() if i != a}
        same = sorted((i for i in score if rows[i][0] == label), key=lambda i: (-score[i], i))[:5]
        other = sorted((i for i in score if rows[i][0] != label), key=lambda i: (-score[i], i))
        for p in same:
            fit = [i for i in other if 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def made(n=900, width=8, hot=0.4):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(12)]
    rows = [(i - 5, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], 0 if rng.random() < hot else rng.randrange(6), 1)
            for i in range(n)]
    rows += [(n + i, [0.5] * width, i % 3, 1) for i in range(200)]                       # copies, over three labels
    rows += [(5000, None, 1, 1), (5050, [None] + [1.0] * (width - 1), 1, 1), (5100, [float("nan")] * width, 1, 1),
             (5150, [float("inf")] * width, 1, 1), (None, [1.0] * width, 1, 1), (5200, [0.1] * width, None, 1),
             (5250, [0.0] * width, 2, 1), (5300, [1.0, 2.0], 2, 1), (5350, [], 3, 1), (5400, [0.3] * width, 77, 1), rows[45]]
    return rows


@pytest.mark.parametrize("components", [600, 1 << 19])
def test_against_every_pair(spark, monkeypatch, components):
    monkeypatch.setattr(V, "BLOCK_COMPONENTS", components)      # many blocks, one block
    rows = made()
    assert got(G.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)) == brute(rows)


def test_large_components_and_scores_beyond_a_long(spark):
    rows = [(i, [float((i * 37) % 11 - 5), float(i % 7)], i % 2, 1) for i in range(60)]
    rows += [(100 + i, [2.0 ** (20 + i), -1.0], i % 2, 1) for i in range(0, 40, 3)] + [(150, [2.0 ** 40, 2.0 ** 45], 0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(G.hard_negatives(df, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_tree_leaves_subtrees_out_and_finds_the_same():
    rng = np.random.default_rng(1)
    x = np.floor(np.repeat(rng.normal(0, 300, (40, 16)), 100, axis=0) + rng.normal(0, 12, (4000, 16)))
    labels, ids = rng.integers(0, 3, 4000), rng.permutation(4000)
    tree, q = G.Tree(x, ids, labels), x[:50]
    low = np.floor((q * q).sum(axis=1) * 0.5).astype(np.int64)
    high = np.floor((q * q).sum(axis=1) * 0.95).astype(np.int64)
    found, scores = tree.best(q, ids[:50], labels[:50], low, high, np.arange(50), False, 3)
    assert tree.scored < 0.5 * 50 * 4000
    for w in range(50):
        s = (x @ q[w]).astype(np.int64)
        fit = np.flatnonzero((labels != labels[w]) & (s >= low[w]) & (s <= high[w]))
        fit = fit[np.lexsort((ids[fit], -s[fit]))][:3]
        assert found[w][found[w] >= 0].tolist() == fit.tolist() and scores[w][:len(fit)].tolist() == s[fit].tolist()


def test_ranges_hold_every_row_below():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 100, (1500, 5)))
    tree = G.Tree(x, np.arange(1500), np.zeros(1500, int))

    def rows_of(node):
        return node.rows if node.rows is not None else np.concatenate([rows_of(c) for c in node.children])

    def check(node):
        if node.rows is None:
            for j, c in enumerate(node.children):
                for i, p in enumerate(node.points):
                    d = tree._distances(rows_of(c), p)
                    assert node.near[i, j] <= d.min() + 1e-9 and d.max() <= node.far[i, j] + 1e-9
                check(c)

    check(tree.root)
    assert sorted(rows_of(tree.root)) == list(range(1500))


def test_nothing_to_mine_and_shifted_labels(spark):
    everything = F.col("vec_id") % 50 == 0
    assert G.hard_negatives(spark.createDataFrame([], SCHEMA), everything).count() == 0
    lone = [(0, [1.0], 0, 1), (1, [1.0], 1, 1), (50, [-1.0], 2, 1)]
    assert G.hard_negatives(spark.createDataFrame(lone, SCHEMA), everything).count() == 0
    labels = {r.vec_id: r.label for r in G.shifted_labels(spark.createDataFrame(
        [(7, [1.0], 9, 1), (8, [1.0], 9, 1), (14, None, None, 1), (None, [1.0], 4, 1)], SCHEMA)).collect()}
    assert labels == {7: 0, 8: 9, 14: None, None: 4}


def test_tables_and_oracle(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in G.shifted_labels(table(spark, SF01, "embeddings")).collect()]
    assert got(QUERIES["op13_hard_negatives"](spark, SF01)) == brute(rows)
    r = compare(QUERIES["op13_hard_negatives"](spark, SF001), ORACLE["op13_hard_negatives"], SF001)
    assert r["columns_match"] and r["values_match"], r
