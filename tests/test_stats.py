"""Summary statistics against numpy (A8, A12-A14) for groups of all sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from histshift.operators import stats as st


def test_exact_quantiles_small(spark):
    vals = [1.0, 2.5, 7.0, 9.0, None, 11.5]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    qs = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    r = st.exact_quantiles(df, ["g"], "v", qs, [f"q{i}" for i in range(7)]).collect()[0]
    assert list(r)[1:] == pytest.approx([1.3, 1.6, 2.5, 7.0, 9.0, 10.5, 11.0])


def test_exact_quantiles_large_group_matches_numpy(spark):
    n = 250_000
    df = spark.range(n).select(F.lit("big").alias("g"),
                               (F.floor(F.rand(3) * 5000) / 7).alias("v"))   # many ties
    small = spark.createDataFrame([("small", float(x)) for x in range(11)], "g string, v double")
    both = df.unionByName(small)
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    got = {r.g: list(r)[1:] for r in st.exact_quantiles(both, ["g"], "v", qs, list("abcde")).collect()}
    vals = np.array([r.v for r in df.collect()])
    assert got["big"] == pytest.approx(list(np.quantile(vals, qs)), abs=1e-9)
    assert got["small"] == pytest.approx(list(np.quantile(np.arange(11.0), qs)))


def test_box_stats_match_definition(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(10, 2, 500), [40.0, -30.0]])
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    r = st.box_stats(df, ["g"], "v").collect()[0]
    q1, q2, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = vals[(vals >= lo) & (vals <= hi)]
    assert (r.lower, r.middle, r.upper) == pytest.approx((q1, q2, q3))
    assert (r.ymin, r.ymax) == pytest.approx((inside.min(), inside.max()))
    assert r.n == len(vals) and r.n_outliers == len(vals) - len(inside)
    out = st.box_outliers(df, ["g"], "v").count()
    assert out == r.n_outliers


def test_violin_density_integrates_to_about_one(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("g", float(v)) for v in rng.normal(0, 1, 2000)], "g string, v double")
    d = st.violin_density(df, ["g"], "v").orderBy("y").collect()
    ys = np.array([r.y for r in d]); ds = np.array([r.density for r in d])
    assert len(d) == st.VIOLIN_GRID
    assert np.trapezoid(ds, ys) == pytest.approx(1.0, abs=0.03)
    qs = {r.q: r.y for r in st.violin_quantiles(st.violin_density(df, ["g"], "v"), ["g"]).collect()}
    assert qs[0.5] == pytest.approx(0.0, abs=0.1)


def test_linear_trend_matches_polyfit(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(np.arange(10.0), 30)
    y = 3 + 0.5 * x + rng.normal(0, 1, len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    rows = st.linear_trend(df, "x", "y").orderBy("x").collect()
    slope, intercept = np.polyfit(x, y, 1)
    assert rows[0].slope == pytest.approx(slope) and rows[0].intercept == pytest.approx(intercept)
    assert len(rows) == 10 and all(r.lower < r.fit < r.upper for r in rows)


def test_log10_drops_non_positive(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (-1.0,)], "v double")
    assert [r.v for r in st.log10_positive(df, "v").collect()] == [2.0]


def test_approx_quantiles_option(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    r = st.group_quantiles(df, ["g"], "v", (0.5,), ("m",), approx=True).collect()[0]
    assert r.num_clients == 1000 and abs(r.m - 499.5) <= 1.0


def test_exact_quantiles_random_groups_with_a_coarse_sketch(spark):
    rng = np.random.default_rng(9)
    groups = {f"g{k}": rng.choice(rng.normal(size=max(1, n // 3)), n) for k, n in enumerate((1, 2, 3, 7, 40, 999, 5000))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    qs = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    for accuracy in (200, st.DEFAULT_ACCURACY):
        got = {r.g: list(r)[1:] for r in st.exact_quantiles(df, ["g"], "v", qs, list("abcdefh"), accuracy).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            assert got[g] == pytest.approx(list(np.quantile(vs, qs)), abs=1e-12)


def test_a_missed_bracket_falls_back_to_the_exact_aggregate(spark):
    counts = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 2), ("b", 3.0, 1)], "g string, _v double, _c long")
    wide = spark.createDataFrame([("a", None, True), ("b", 3.0, False)], "g string, m double, _missed boolean")
    got = {r.g: r.m for r in st._with_fallback(wide, counts, ["g"], (0.5,), ("m",)).collect()}
    assert got == {"a": 3.0, "b": 3.0}


def test_constant_groups_keep_their_violin(spark):
    df = spark.createDataFrame([("c", 4.0)] * 5 + [("one", 0.0)] + [("d", float(k)) for k in range(9)], "g string, v double")
    dens = st.violin_density(df, ["g"], "v")
    rows = {g: [(r.y, r.density) for r in dens.collect() if r.g == g] for g in ("c", "one", "d")}
    assert len(rows["d"]) == st.VIOLIN_GRID and len(rows["c"]) == len(rows["one"]) == 1
    assert rows["c"][0] == (4.0, pytest.approx(1 / (0.9 * 4 * 5 ** -0.2 * np.sqrt(2 * np.pi))))
    lines = {(r.g, r.q): r.y for r in st.violin_quantiles(dens, ["g"]).collect()}
    assert lines["c", 0.25] == lines["c", 0.75] == 4.0 and len(lines) == 9


#: Quantile 0.975 of Student's t by degrees of freedom: fixed values of the printed tables.
T_975 = {1: 12.7062047364, 2: 4.3026527297, 3: 3.1824463053, 4: 2.7764451052, 5: 2.5705818366, 6: 2.4469118511,
         7: 2.3646242516, 8: 2.3060041352, 9: 2.2621571628, 10: 2.2281388520, 12: 2.1788128297, 15: 2.1314495456,
         20: 2.0859634473, 25: 2.0595385528, 28: 2.0484071418, 30: 2.0422724563, 60: 2.0002978221, 100: 1.9839715185,
         120: 1.9799304051, 200: 1.9718962236, 500: 1.9647198375, 1000: 1.9623390808, 10 ** 9: 1.9599639869}


def test_student_t_equals_the_tables(spark):
    df = spark.createDataFrame([(n,) for n in (-1, 0, *T_975)], "n long").withColumn("t", st.student_t(0.975, F.col("n")))
    got = {r.n: r.t for r in df.collect()}
    assert got.pop(-1) is None and got.pop(0) is None
    assert got == pytest.approx(T_975, abs=1e-8)


def test_trend_band_of_few_rows_is_students(spark):
    rng = np.random.default_rng(4)
    for n in (3, 4, 7, 30):
        x = 19_700 + np.arange(n, dtype=float)
        y = 5 + 0.3 * x + rng.normal(0, 2, n)
        rows = st.linear_trend(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "x", "y").orderBy("x").collect()
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        fit = y.mean() + slope * (x - x.mean())
        s2 = ((y - fit) ** 2).sum() / (n - 2)
        se = np.sqrt(s2 * (1 / n + (x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
        t = st.t_quantile(0.975, n - 2)
        assert [r.fit for r in rows] == pytest.approx(list(fit), abs=1e-8)
        assert [r.upper - r.fit for r in rows] == pytest.approx(list(t * se), abs=1e-6)
        assert rows[0].slope == pytest.approx(slope, rel=1e-10) and rows[0].n == n
    two = st.linear_trend(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, y double"), "x", "y").collect()
    assert {r.slope for r in two} == {2.0} and all(r.lower is None for r in two)
    one = st.linear_trend(spark.createDataFrame([(1.0, 1.0), (1.0, 3.0)], "x double, y double"), "x", "y").collect()
    assert one[0].slope is None and st.linear_trend(spark.createDataFrame([], "x double, y double"), "x", "y").count() == 0


def r_density(v, n=512):
    """R's density(v, bw = "nrd0", from = min(v), to = max(v)), step by step, with its FFT."""
    sd, iqr = np.std(v, ddof=1), np.subtract(*np.quantile(v, [0.75, 0.25]))
    low = min(sd, iqr / 1.34) or sd or abs(v[0]) or 1.0
    bw = 0.9 * low * len(v) ** -0.2
    lo, up = v.min() - 4 * bw, v.max() + 4 * bw
    delta = (up - lo) / (n - 1)
    pos = (v - lo) / delta
    ix = np.floor(pos).astype(int)
    y = np.zeros(2 * n)
    np.add.at(y, ix, (1 - (pos - ix)) / len(v))
    np.add.at(y, ix + 1, (pos - ix) / len(v))
    k = np.linspace(0, 2 * (up - lo), 2 * n)
    k[n + 1:] = -k[n - 1:0:-1]
    k = np.exp(-0.5 * (k / bw) ** 2) / (bw * np.sqrt(2 * np.pi))
    d = np.maximum(0, np.real(np.fft.ifft(np.fft.fft(y) * np.conj(np.fft.fft(k))))[:n])
    x = np.linspace(v.min(), v.max(), n)
    return x, np.interp(x, np.linspace(lo, up, n), d)


def test_violin_equals_rs_density_without_a_join_on_the_grid(spark):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(0, 1, 400), "b": np.r_[rng.normal(-50, 1, 90), rng.normal(900, 3, 90)],
              "c": np.array([1.0, 1.0, 1.0, 1.0, 7.0]), "d": np.array([0.0, 1e-3]), "e": np.repeat([5.0, 6.0], 200)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double")
    dens = st.violin_density(df, ["g"], "v")
    for g, v in groups.items():
        rows = sorted((r.y, r.density) for r in dens.collect() if r.g == g)
        x, d = r_density(v)
        assert [r[0] for r in rows] == pytest.approx(list(x), abs=1e-9)
        assert [r[1] for r in rows] == pytest.approx(list(d), abs=1e-6 * max(1.0, d.max()))
    from tests.test_plans import plan
    text = plan(dens, "simple")
    assert text.count("hashpartitioning(g") and "explode(sequence(0, 511" not in text.replace(" ", "")
