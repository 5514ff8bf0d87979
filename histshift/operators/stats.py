"""Summary statistics of client means.

Groups here are builds, and a build may hold a third of all clients, so no statistic
gathers a group's rows in one task. Values are first counted per (group, value), which
absorbs ties before the shuffle; what has to meet a per-group row (brackets, fences, grids)
meets it by (group, salt), the salt being a hash of the value, and is aggregated per
(group, salt), then per group.

* exact quantiles: ``approx_percentile`` brackets each target rank (its rank error is at
  most n/accuracy); counts below the brackets are partial sums, and only the values inside
  a bracket (about 8 n/accuracy) are ranked, as rows of a window per (group, quantile). One
  method for all group sizes; a bracket that missed its rank falls back to ``percentile``.
* box statistics: quantiles, then min/max/count of in-fence values (algebraic).
* violin: values are linearly binned onto a fixed grid (partial aggregation); a group's bins
  are one array of the grid's size, convolved with the kernel where it does not vanish.
* linear trend: sums per distinct x (one pass), then around the means; Student's t for the band.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000
BOX_COEF = 1.5
VIOLIN_GRID = 512
#: The violin's grid reaches so many bandwidths past the values, and its kernel counts as 0
#: beyond so many (there it is below 1e-17 of its peak).
VIOLIN_CUT, VIOLIN_REACH = 4, 9
BAND = 0.95
SALT = "_salt"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where body uses it inside lambdas (a column
    of a projection below could be inlined there and evaluated again for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def value_counts(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys, _v, _c): how often each non-missing value occurs; NULL and NaN ignored."""
    data = df.select(*keys, F.col(value).cast("double").alias("_v"))
    return (data.filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v")))
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))


def salted_join(counts: DataFrame, per_group: DataFrame, keys) -> DataFrame:
    """Rows of ``counts`` with their group's row, joined by (keys, salt): a hot group is
    spread over as many tasks as the session shuffles to, broadcast or not."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = per_group.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    salted = counts.withColumn(SALT, F.pmod(F.xxhash64("_v"), F.lit(n)).cast("int"))
    return salted.join(copies, [*keys, SALT])


def exact_quantiles(df: DataFrame, keys, value: str, qs, names,
                    accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Exact linear-interpolation quantiles (R type 7, pandas, DuckDB quantile_cont)
    of ``value`` per ``keys``, NULL and NaN ignored. Returns keys + one column per name."""
    keys = list(keys)
    nq, margin = len(qs), 4.0 / accuracy
    data = df.select(*keys, F.col(value).cast("double").alias("_v"))
    data = data.filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v")))
    counts = value_counts(df, keys, value)
    # The value returned for p has a 0-based rank within ceil(p n) - 1 +- n/accuracy; the ranks
    # floor((n-1)q) and ceil((n-1)q) lie at most one off the brackets q -+ margin, and the next
    # values on either side cover that.
    pcts = [max(0.0, q - margin) for q in qs] + [min(1.0, q + margin) for q in qs]
    brackets = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.expr(f"approx_percentile(_v, array({', '.join(map(repr, pcts))}), {int(accuracy)})").alias("_b"))
    met = salted_join(counts, brackets, keys)
    x, c = F.col("_v"), F.col("_c")
    aggs, again = [], []
    for i in range(nq):
        lo, hi = F.col("_b")[i], F.col("_b")[nq + i]
        aggs += [F.sum(F.when(x < lo, c)).alias(f"_below{i}"), F.sum(F.when((x >= lo) & (x <= hi), c)).alias(f"_in{i}"),
                 F.max(F.when(x < lo, x)).alias(f"_prev{i}"), F.min(F.when(x > hi, x)).alias(f"_next{i}")]
        again += [F.sum(f"_below{i}").alias(f"_below{i}"), F.sum(f"_in{i}").alias(f"_in{i}"),
                  F.max(f"_prev{i}").alias(f"_prev{i}"), F.min(f"_next{i}").alias(f"_next{i}")]
    sides = (met.groupBy(*keys, SALT).agg(F.first("_n").alias("_n"), *aggs)
             .groupBy(*keys).agg(F.first("_n").alias("_n"), *again))
    pos = (F.col("_n") - 1).cast("double") * F.col("_s._q")
    ranks = sides.select(*keys, "_n", F.explode(F.array(*[F.struct(
        F.lit(i).alias("_i"), F.lit(float(q)).alias("_q"), F.coalesce(f"_below{i}", F.lit(0)).alias("_below"),
        F.coalesce(f"_in{i}", F.lit(0)).alias("_in"), F.col(f"_prev{i}").alias("_prev"),
        F.col(f"_next{i}").alias("_next")) for i, q in enumerate(qs)])).alias("_s")).select(
        *keys, "_s.*", pos.alias("_pos"), F.floor(pos).alias("_r0"), F.ceil(pos).alias("_r1"))

    inside = met.select(*keys, "_v", "_c", F.explode(F.array(*[
        F.when((x >= F.col("_b")[i]) & (x <= F.col("_b")[nq + i]), F.lit(i)) for i in range(nq)])).alias("_i"))
    inside = inside.filter(F.col("_i").isNotNull())
    by_value = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.sum("_c").over(by_value))
    rows = ranks.join(inside, [*keys, "_i"], "left")

    def at(rank):
        r = F.col(rank) - F.col("_below")
        here = F.max(F.when((r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")), F.col("_v")))
        first = {k: F.first(k) for k in ("_below", "_in", "_prev", "_next", rank)}
        return (F.when(first[rank] == first["_below"] - 1, first["_prev"])
                .when(first[rank] == first["_below"] + first["_in"], first["_next"]).otherwise(here))

    found = rows.groupBy(*keys, "_i").agg(at("_r0").alias("_x0"), at("_r1").alias("_x1"),
                                          (F.first("_pos") - F.first("_r0")).alias("_f"))
    value_at = F.col("_x0") + F.col("_f") * (F.col("_x1") - F.col("_x0"))
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, value_at)).alias(n) for i, n in enumerate(names)],
        F.bool_or(F.col("_x0").isNull() | F.col("_x1").isNull()).alias("_missed"))
    return _with_fallback(wide, counts, keys, qs, names)


def _with_fallback(wide: DataFrame, counts: DataFrame, keys, qs, names) -> DataFrame:
    """Groups whose bracket missed a rank (the sketch's bound rules it out) are answered by
    the exact aggregate over their value counts instead of failing."""
    missed = wide.filter("_missed").select(*keys)
    arr = ", ".join(repr(float(q)) for q in qs)
    exact = counts.join(missed, keys, "left_semi").groupBy(*keys).agg(F.expr(f"percentile(_v, array({arr}), _c)").alias("_a"))
    return wide.filter(~F.col("_missed")).drop("_missed").unionByName(
        exact.select(*keys, *[F.col("_a")[i].alias(n) for i, n in enumerate(names)]))


def approx_quantiles(df: DataFrame, keys, value: str, qs, names,
                     accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One-pass approximate quantiles (rank error <= n/accuracy), for very large groups
    when the exact two-pass method is not worth its second pass."""
    keys = list(keys)
    arr = ", ".join(repr(float(q)) for q in qs)
    q = df.groupBy(*keys).agg(
        F.expr(f"approx_percentile(`{value}`, array({arr}), {int(accuracy)})").alias("_a"))
    return q.select(*keys, *[F.col("_a")[i].alias(n) for i, n in enumerate(names)])


def group_quantiles(df: DataFrame, keys, value: str, qs, names,
                    accuracy: int = DEFAULT_ACCURACY, approx: bool = False) -> DataFrame:
    """Quantiles (exact by default) plus ``num_clients`` = all rows of the group
    (NULL values included)."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_clients"))
    fn = approx_quantiles if approx else exact_quantiles
    q = fn(df, keys, value, qs, names, accuracy)
    return counts.join(q, keys, "left")


def box_stats(df: DataFrame, keys, value: str, coef: float = BOX_COEF,
              accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """lower/middle/upper quartiles, whiskers at the most extreme values within
    coef x IQR of the box, and the number of values outside (ggplot2 stat_boxplot)."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, (0.25, 0.5, 0.75), ("lower", "middle", "upper"), accuracy)
    iqr = F.col("upper") - F.col("lower")
    q = q.withColumn("_flo", F.col("lower") - coef * iqr).withColumn("_fhi", F.col("upper") + coef * iqr)
    x, c = F.col("_v"), F.col("_c")
    inside = (x >= F.col("_flo")) & (x <= F.col("_fhi"))
    met = salted_join(value_counts(df, keys, value), q.select(*keys, "_flo", "_fhi"), keys)
    agg = (met.groupBy(*keys, SALT).agg(
        F.sum("_c").alias("n"), F.min(F.when(inside, x)).alias("ymin"), F.max(F.when(inside, x)).alias("ymax"),
        F.sum(F.when(inside, F.lit(0)).otherwise(c)).alias("n_outliers"))
        .groupBy(*keys).agg(F.sum("n").alias("n"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"),
                            F.sum("n_outliers").alias("n_outliers")))
    return q.drop("_flo", "_fhi").join(agg, keys)


def box_outliers(df: DataFrame, keys, value: str, coef: float = BOX_COEF,
                 accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """The rows outside the whiskers' fences."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, (0.25, 0.75), ("lower", "upper"), accuracy)
    iqr = F.col("upper") - F.col("lower")
    x = F.col(value)
    rows = df.filter(x.isNotNull()).withColumn("_v", x.cast("double"))
    return salted_join(rows, q, keys).filter((x < F.col("lower") - coef * iqr) | (x > F.col("upper") + coef * iqr)) \
            .select(*df.columns)


def _nrd0(sd, iqr, n, at):
    """R's bw.nrd0: 0.9 * min(sd, IQR/1.34) * n^-0.2; where that is 0, sd, then |x|, then 1
    stand for the minimum."""
    lo = F.least(sd, iqr / 1.34)
    lo = F.when(lo > 0, lo).when(sd > 0, sd).when(at != 0, F.abs(at)).otherwise(F.lit(1.0))
    return 0.9 * lo * F.pow(n.cast("double"), -0.2)


def violin_density(df: DataFrame, keys, value: str, grid: int = VIOLIN_GRID,
                   accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Gaussian kernel density per group at ``grid`` points over the group's range (trim),
    bandwidth nrd0, as R's density() computes it: values are binned linearly on a grid that
    reaches four bandwidths past the range, the bins are convolved with the kernel, and the
    result is interpolated linearly at the points asked for. (As in R, the kernel's steps are
    2 L / (2 grid - 1), L being the grid's length, a little below the bins' own.) The bins of a
    group are one array, so the convolution joins nothing. A group whose values are all equal
    has one point, at that value."""
    keys = list(keys)
    counts = value_counts(df, keys, value)
    mom = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(F.col(value).cast("double")).alias("_sd"),
        F.min(F.col(value).cast("double")).alias("_min"), F.max(F.col(value).cast("double")).alias("_max"))
    q = exact_quantiles(df, keys, value, (0.25, 0.75), ("_q1", "_q3"), accuracy)
    flat = F.col("_max") == F.col("_min")
    par = mom.join(q, keys)
    par = par.withColumn("_bw", _nrd0(F.when(~flat, F.col("_sd")).otherwise(F.lit(0.0)), F.col("_q3") - F.col("_q1"),
                                      F.col("_n"), F.col("_min")))
    par = par.withColumn("_lo", F.col("_min") - VIOLIN_CUT * F.col("_bw"))
    par = par.withColumn("_len", F.col("_max") + VIOLIN_CUT * F.col("_bw") - F.col("_lo"))
    # linear binning: each value splits its weight between the two grid points around it
    pos = (F.col("_v") - F.col("_lo")) / (F.col("_len") / (grid - 1))
    k0 = F.floor(pos).cast("int")
    b = salted_join(counts, par.select(*keys, "_n", "_bw", "_min", "_max", "_lo", "_len"), keys).select(
        *keys, "_n", "_bw", "_min", "_max", "_lo", "_len",
        F.inline(F.array(F.struct(k0.alias("k"), ((1 - (pos - k0)) * F.col("_c")).alias("c")),
                         F.struct((k0 + 1).alias("k"), ((pos - k0) * F.col("_c")).alias("c")))))
    group = [F.first(c).alias(c) for c in ("_n", "_bw", "_min", "_max", "_lo", "_len")]
    bins = b.groupBy(*keys, "k").agg(F.sum("c").alias("c"), *group)
    one = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("_m"), *group)
    every = F.sequence(F.lit(0), F.lit(grid - 1))
    weights = F.transform(every, lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)) / F.col("_n"))
    lag = 2 * F.col("_len") / (2 * grid - 1)
    peak = 1 / (F.col("_bw") * math.sqrt(2 * math.pi))
    reach = F.least(F.lit(grid - 1), F.ceil(VIOLIN_REACH * F.col("_bw") / lag).cast("int"))

    def kernel(far):
        return F.transform(F.sequence(F.lit(0), far), lambda m: peak * F.exp(-0.5 * F.pow(m * lag / F.col("_bw"), 2)))

    def convolved(y, w, far):
        def at(i):
            near = F.sequence(F.greatest(F.lit(0), i - far), F.least(F.lit(grid - 1), i + far))
            return F.aggregate(near, F.lit(0.0), lambda s, j: s + F.get(y, j) * F.get(w, F.abs(i - j)))
        return F.transform(every, at)

    def points(d):
        def point(t):
            y = F.when(t == grid - 1, F.col("_max")).otherwise(F.col("_min") + t * ((F.col("_max") - F.col("_min")) / (grid - 1)))
            x = (y - F.col("_lo")) / (F.col("_len") / (grid - 1))
            left = F.least(F.floor(x).cast("int"), F.lit(grid - 2))
            low, high = F.get(d, left), F.get(d, left + 1)
            return F.struct(y.alias("y"), (low + (x - left) * (high - low)).alias("density"))
        return F.transform(every, point)

    curve = let(reach, lambda far: let(weights, lambda y: let(kernel(far), lambda w: let(convolved(y, w, far), points))))
    flat = F.array(F.struct(F.col("_min").alias("y"), peak.alias("density")))
    return one.select(*keys, F.inline(F.when(F.col("_max") == F.col("_min"), flat).otherwise(curve)))


def violin_quantiles(dens: DataFrame, keys, qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Quantile lines of a violin: y where the cumulative density reaches q,
    linear between grid points (ggplot2 draw_quantiles). One grid per group; a grid of one
    point answers every quantile."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("y")
    tot = Window.partitionBy(*keys)
    c = dens.withColumn("_cd", F.sum("density").over(w.rowsBetween(Window.unboundedPreceding, 0))
                        / F.sum("density").over(tot))
    c = c.withColumn("_pcd", F.coalesce(F.lag("_cd").over(w), F.lit(0.0))) \
         .withColumn("_py", F.coalesce(F.lag("y").over(w), F.col("y")))
    qv = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    c = c.select(*keys, "y", "_cd", "_pcd", "_py", qv)
    hit = c.filter((F.col("_pcd") < F.col("q")) & (F.col("_cd") >= F.col("q")))
    yq = F.col("_py") + (F.col("q") - F.col("_pcd")) * (F.col("y") - F.col("_py")) \
        / (F.col("_cd") - F.col("_pcd"))
    return hit.select(*keys, "q", yq.alias("y"))


T_TABLE = 100


@cache
def t_quantile(p: float, df: int) -> float:
    """The quantile ``p`` > 0.5 of Student's t for whole degrees of freedom: bisection on the
    distribution's finite series in the angle atan(t / sqrt(df))."""
    def inside(angle):          # probability of |T| up to that angle
        c, s = math.cos(angle), math.sin(angle)
        term, total = (c, c) if df % 2 else (1.0, 1.0)
        for k in range(3 if df % 2 else 2, df - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        if df % 2:
            return 2 / math.pi * (angle + (s * total if df > 1 else 0.0))
        return s * total

    low, high = 0.0, math.pi / 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) < 2 * p - 1 else (low, mid)
    return math.sqrt(df) * math.tan(low)


def student_t(p: float, df: Column) -> Column:
    """``t_quantile`` of a column of degrees of freedom: up to ``T_TABLE`` from the function, above
    by the expansion around the normal quantile in powers of 1 / df, whose error is below 1e-9
    there. Null below 1."""
    z = NormalDist().inv_cdf(p)
    terms = ((z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96,
             (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
             (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160)
    far = F.lit(z)
    for k, g in enumerate(terms, 1):
        far = far + F.lit(g) / F.pow(df.cast("double"), F.lit(float(k)))
    table = F.array(*[F.lit(t_quantile(p, k)) for k in range(1, T_TABLE + 1)])
    return F.when(df > T_TABLE, far).when(df >= 1, F.get(table, (df - 1).cast("int")))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x over all rows (one group) with its 95 % confidence band
    (Student's t; null below three rows). Returns one row per distinct x with the fit."""
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    # one pass over the rows: per distinct x; sums around the means follow from those few rows
    # without the cancellation of dates in the tens of thousands
    xs = d.groupBy("_x").agg(F.count(F.lit(1)).alias("_c"), F.avg("_y").alias("_m"),
                             (F.var_pop("_y") * F.count(F.lit(1))).alias("_within")).withColumn("_one", F.lit(1))
    means = xs.groupBy("_one").agg(F.sum("_c").alias("n"), (F.sum(F.col("_c") * F.col("_x")) / F.sum("_c")).alias("avgx"),
                                   (F.sum(F.col("_c") * F.col("_m")) / F.sum("_c")).alias("avgy"))
    dx, dy, c = F.col("_x") - F.col("avgx"), F.col("_m") - F.col("avgy"), F.col("_c")
    fit = xs.join(F.broadcast(means), "_one").groupBy("_one").agg(          # one row, as ``means``
        F.first("n").alias("n"), F.first("avgx").alias("avgx"), F.first("avgy").alias("avgy"),
        F.sum(c * dx * dx).alias("sxx"), F.sum(c * dx * dy).alias("sxy"), F.sum(F.col("_within") + c * dy * dy).alias("syy"))
    fit = fit.withColumn("slope", F.try_divide("sxy", "sxx")).withColumn("intercept", F.col("avgy") - F.col("slope") * F.col("avgx"))
    fit = fit.withColumn("r2", F.when(F.col("sxx") > 0, F.when(F.col("syy") > 0, F.pow("sxy", F.lit(2.0)) / (F.col("sxx") * F.col("syy")))
                                      .otherwise(1.0)))
    fit = fit.withColumn("_t", student_t((1 + BAND) / 2, F.col("n") - 2))
    # the fit is a single row: attach it with an equi-join on a constant key
    j = xs.join(F.broadcast(fit), "_one")
    yhat = F.col("avgy") + F.col("slope") * (F.col("_x") - F.col("avgx"))
    s2 = F.try_divide(F.col("syy") * (1 - F.col("r2")), F.col("n") - 2)
    se = F.sqrt(s2 * (1 / F.col("n") + F.pow(F.col("_x") - F.col("avgx"), 2) / F.col("sxx")))
    return j.select(F.col("_x").alias(x), "slope", "intercept", "r2", "n",
                    yhat.alias("fit"), (yhat - F.col("_t") * se).alias("lower"),
                    (yhat + F.col("_t") * se).alias("upper"))


def log10_positive(df: DataFrame, value: str) -> DataFrame:
    """log10 of the values; non-positive values drop out (as on a log10 scale)."""
    return df.filter(F.col(value) > 0).withColumn(value, F.log10(F.col(value)))

