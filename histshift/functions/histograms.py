"""Expressions over histogram bins.

A histogram lives in long form, one row or one array element per bin:
``struct<probe string, metric int, measure double>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimated(count: Column, estimator: bool) -> Column:
    """F2: +0.5 on every bin present (missing bins stay missing)."""
    c = count.cast("double")
    return c + F.lit(0.5) if estimator else c


def merge_hist_maps(a: str | Column, b: str | Column) -> Column:
    """F5 on map columns: key-union sum of two histograms (a missing side counts 0;
    a NULL map is an empty histogram)."""
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    ca = F.coalesce(ca, F.create_map().cast("map<int,double>"))
    cb = F.coalesce(cb, F.create_map().cast("map<int,double>"))
    return F.map_zip_with(ca, cb, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
