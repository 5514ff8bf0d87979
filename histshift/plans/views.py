"""Dashboard views as DataFrames.

Each view takes a published snapshot and the user's selections as arguments and
returns rows; filters run before any statistic (Q21), as axis limits do in the plots.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.config import CLIENT_MEAN_QUANTILES, DEFAULT_WINDOW_DAYS, REGRESSION_THRESHOLD
from histshift.functions.dates import build_date
from histshift.functions.naming import percent_names
from histshift.operators import snapshots as sn
from histshift.operators import stats as st

DETAIL_COLUMNS = ("app_build_id", "num_profiles", "num_pings", "relds_05", "relds_25",
                  "relds_5", "relds_75", "relds_95")


def _date_range(df: DataFrame, x_range, col: str = "app_build_id") -> DataFrame:
    if x_range is None:
        return df
    lo, hi = x_range
    d = build_date(col)
    return df.filter(d.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def relds_series(relds: DataFrame, probe: str, x_range=None,
                 th: float = REGRESSION_THRESHOLD) -> DataFrame:
    """Median with 25 %-95 % bars, size = profiles, regression flag."""
    df = _date_range(relds.filter(F.col("probe") == F.lit(probe)), x_range)
    return df.select("app_build_id", "relds_5", "relds_25", "relds_95", "num_profiles",
                     (F.col("relds_95") >= F.lit(float(th))).alias("thresh"))


def build_detail(relds: DataFrame, probe: str) -> DataFrame:
    """The eight detail columns of one probe."""
    return relds.filter(F.col("probe") == F.lit(probe)).select(*DETAIL_COLUMNS)


def nearest_builds(relds: DataFrame, probe: str, at_date, y: float, k: int = 1) -> DataFrame:
    """The k rows of the series nearest to a point (days first, then RelDS);
    a top-k: Spark plans it as TakeOrderedAndProject (k rows per task, then k)."""
    d = build_detail(relds, probe)
    dd = F.abs(F.datediff(build_date("app_build_id"), F.lit(at_date).cast("date")))
    dy = F.abs(F.col("relds_5") - F.lit(float(y)))
    return d.orderBy(dd, dy, "app_build_id").limit(k)


def default_window(relds: DataFrame, days: int = DEFAULT_WINDOW_DAYS) -> DataFrame:
    """Newest build, newest minus ``days`` (the default start) and the oldest."""
    agg = relds.agg(F.max("app_build_id").alias("max_build"), F.min("app_build_id").alias("min_build"))
    start = F.date_format(F.date_sub(build_date("max_build"), days), "yyyyMMdd")
    return agg.select("min_build", "max_build", start.alias("start_build"))


def distinct_builds(df: DataFrame) -> DataFrame:
    """A10."""
    return df.select("app_build_id").distinct()


def probe_labels(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach the probe's label; the planner sees how small the dimension is."""
    return df.join(dim, "probe")


def _means_of(means: DataFrame, probe: str, x_range=None, y_range=None, log10=False) -> DataFrame:
    df = _date_range(means.select("app_build_id", F.col(probe).alias("value")), x_range)
    if log10:
        df = st.log10_positive(df, "value")
    if y_range is not None:
        df = df.filter(F.col("value").between(float(y_range[0]), float(y_range[1])))
    return df


def means_quantiles(means: DataFrame, probe: str, at_date: dt.date | str,
                    qs=CLIENT_MEAN_QUANTILES, approx: bool = False) -> DataFrame:
    """Client-mean quantiles on one build date and the number of clients
    (exact unless ``approx``)."""
    d = means.filter(build_date("app_build_id") == F.lit(at_date).cast("date"))
    d = d.select("app_build_id", F.col(probe).alias("value"))
    return st.group_quantiles(d, ["app_build_id"], "value", qs, percent_names(qs), approx=approx)


def box_view(means: DataFrame, probe: str, x_range=None, y_range=None, log10=False) -> DataFrame:
    """E6/A12 (+P15, P22): box statistics per build."""
    return st.box_stats(_means_of(means, probe, x_range, y_range, log10), ["app_build_id"], "value")


def box_outliers_view(means: DataFrame, probe: str, x_range=None, y_range=None, log10=False):
    return st.box_outliers(_means_of(means, probe, x_range, y_range, log10), ["app_build_id"], "value")


def violin_view(means: DataFrame, probe: str, x_range=None, y_range=None, log10=False,
                grid: int = st.VIOLIN_GRID) -> DataFrame:
    """Density per build on a grid."""
    return st.violin_density(_means_of(means, probe, x_range, y_range, log10),
                             ["app_build_id"], "value", grid)


def trend_view(means: DataFrame, probe: str, x_range=None, y_range=None, log10=False):
    """Linear trend of client means over the build date (x = days since 1970-01-01)."""
    df = _means_of(means, probe, x_range, y_range, log10)
    df = df.withColumn("x", F.datediff(build_date("app_build_id"), F.lit("1970-01-01").cast("date")))
    return st.linear_trend(df, "x", "value")


def hist_view(hists: DataFrame, builds, probe: str, x_range=None, recompute: bool = False):
    """Histograms of chosen builds for one probe; the range applies only
    when set, and the CDF is recomputed on the remaining bins only when asked."""
    df = hists.filter(F.col("app_build_id").isin(list(builds)) & (F.col("probe") == F.lit(probe)))
    if x_range is not None:
        df = df.filter(F.col("metric").between(x_range[0], x_range[1]))
        if recompute:
            df = sn.hist_cdf_recomputed(df.drop("cum_sum"))
    return df


def ridge_series(view: DataFrame) -> DataFrame:
    """Build x metric x height, coloured by the CDF."""
    return view.select("app_build_id", "metric", "measure", "cum_sum")


def cdf_series(view: DataFrame) -> DataFrame:
    """One CDF line per build."""
    return view.select("app_build_id", "metric", "cum_sum")


def hist_since(hists: DataFrame, after_build: str, probe: str) -> DataFrame:
    """Strictly newer builds of one probe."""
    return hists.filter((F.col("app_build_id") > F.lit(after_build)) & (F.col("probe") == F.lit(probe))) \
                .select("app_build_id", "measure", "metric", "cum_sum")
