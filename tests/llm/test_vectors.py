import random

import numpy as np

from histshift.llm import ann, topk
from histshift.llm import vectors as V
from histshift.llm.common import table
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_with_ties(n=400, width=6):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(width)], 0) for i in range(n)]
    rows += [(n + i, [0.5] * width, 0) for i in range(80)]                      # a large group of copies
    rows += [(9001, None, 0), (9002, [None] + [1.0] * (width - 1), 0), (9003, [float("nan")] * width, 0),
             (9004, [float("inf")] * width, 0), (None, [1.0] * width, 0), (9020, [0.0] * width, 0), (9005, [1.0, 2.0], 0),
             (0, rows[0][1], 0), (9040, [], 0)]
    return rows


def clean(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = min(out.get(i, v), v)
    return out


def brute(vectors, score, k=20):
    width = max(map(len, vectors.values()))
    pad = {i: list(v) + [0.0] * (width - len(v)) for i, v in vectors.items()}
    out = []
    for q in sorted(vectors):
        if q % 20 == 0:
            best = sorted(((-score(pad[q], pad[i]), i) for i in vectors if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def integer_product(a, b):
    return sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b))


def product(a, b):
    out = 0.0
    for x, y in zip(a, b):
        out += x * y
    return out


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_top_k_with_ties_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_COMPONENTS", 600)     # several blocks
    rows = rows_with_ties()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(topk.top_k(df)) == brute(clean(rows, True), integer_product)
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0), (2, [2.0], 0)], SCHEMA)
    assert got(topk.top_k(few)) == [(0, 1, 1, 8192), (0, 2, 2, 8192)]


def test_threshold_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    x = np.floor(rng.exponential(1.0, (4000, 5)) ** 3)
    lists, ids = topk.SortedLists(x), np.arange(4000)
    for q in np.floor(rng.normal(0, 3, (20, 5))):
        found, scores = lists.top(q, ids, -1)
        want = np.lexsort((ids, -(x @ q)))[:20]
        assert found.tolist() == want.tolist() and (scores == (x @ q)[want]).all()


def test_threshold_stop_scores_part_of_heavy_tailed_vectors_only():
    rng = np.random.default_rng(1)
    x = np.floor(rng.exponential(1.0, (4000, 5)) ** 3)
    lists, queries = topk.SortedLists(x), np.floor(rng.normal(0, 3, (20, 5)))
    for q in queries:
        lists.top(q, np.arange(4000), -1)
    assert 20 * 20 <= lists.scored < 0.5 * 20 * 4000


def test_wide_values_stay_exact():
    x = np.array([[2.0 ** 33, 1.0], [2.0 ** 33, 0.0]])
    assert V.exact_kind(x, x) is np.int64 and V.exact_kind(x[:, 1:], x[:, 1:]) is np.float32


def test_components_of_any_size_and_scores_beyond_a_long(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-9, 9)), rng.random()], 0) for i in range(300)]
    rows += [(1000 + i, [2.0 ** (34 + i), -(2.0 ** (50 - i))], 0) for i in range(17)] + [(1020, [2.0 ** 50, 2.0 ** 50], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def clamped(a, b):
        return min(max(integer_product(a, b), -(1 << 63)), (1 << 63) - 1)

    assert got(topk.top_k(df)) == brute(clean(rows, True), clamped)
    one = [(0, [1.0], 0), (1, [2.0 ** 34], 0), (2, [2.0 ** 36], 0), (3, [2.0 ** 35], 0)]
    found = got(topk.top_k(spark.createDataFrame(one, SCHEMA)))
    assert found == [(0, 1, 2, 2 ** 48), (0, 2, 3, 2 ** 47), (0, 3, 1, 2 ** 46)]


def test_nearest_with_ties_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_COMPONENTS", 900)
    rows = rows_with_ties()
    df = spark.createDataFrame(rows, SCHEMA)
    want, found = brute(clean(rows, False), product), got(ann.nearest(df))
    assert len(found) == len(want) and len(set(found) & set(want)) >= 0.9 * len(want)
    vectors = clean(rows, False)
    assert all(s == product(vectors[q], vectors[i]) for q, _, i, s in found)
    assert ann.nearest(df.limit(0)).count() == 0


def test_recall_on_the_tables(spark):
    e = table(spark, SF01, "embeddings")
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in e.collect() if r.embedding is not None}
    want, found = brute(vectors, product), got(ann.nearest(e))
    assert len({(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)


def test_codes_estimate_inner_products():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 64))
    codes, size, match = ann.encode(x, np.zeros(64), ann.rotation(64))
    estimate = (x @ ann.rotation(64)) @ ann.signs(codes, 64).T * (size / match / 8.0)
    error = np.abs(estimate - x @ x.T) / np.outer(np.linalg.norm(x, axis=1), size)
    bound = ann.EPSILON * np.sqrt((1 - match ** 2) / match ** 2 / 63)
    assert codes.shape == (500, 8) and (error <= bound).mean() > 0.98
