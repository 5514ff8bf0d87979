"""Explicit schemas, generated from the probe list (FIXTURES T1-T9)."""

from __future__ import annotations

from pyspark.sql import types as T

from histshift.config import RELDS_QUANTILES
from histshift.functions.naming import quantile_names

HIST = T.MapType(T.IntegerType(), T.LongType(), valueContainsNull=True)
BIN = T.StructType([
    T.StructField("probe", T.StringType(), False),
    T.StructField("metric", T.IntegerType(), False),
    T.StructField("measure", T.DoubleType(), False),
])


def pings_schema(probes) -> T.StructType:
    return T.StructType([
        T.StructField("client_id", T.StringType(), True),
        T.StructField("app_build_id", T.StringType(), True),
        T.StructField("app_name", T.StringType(), True),
        T.StructField("normalized_channel", T.StringType(), True),
        T.StructField("sample_id", T.StringType(), True),
    ] + [T.StructField(p, HIST, True) for p in probes])


def profile_schema(probes) -> T.StructType:
    return T.StructType([
        T.StructField("client_id", T.StringType(), True),
        T.StructField("app_build_id", T.StringType(), True),
        T.StructField("num_client_pings", T.LongType(), False),
        T.StructField("bins", T.ArrayType(BIN, False), False),
        T.StructField("means", T.StructType([T.StructField(p, T.DoubleType(), True) for p in probes]), False),
    ])


BUILD_STATS = T.StructType([
    T.StructField("app_build_id", T.StringType(), True),
    T.StructField("num_profiles", T.LongType(), False),
    T.StructField("build_pings", T.LongType(), True),
])


def relds_quantiles_schema(quantiles=RELDS_QUANTILES) -> T.StructType:
    return T.StructType([
        T.StructField("probe", T.StringType(), True),
        T.StructField("app_build_id", T.StringType(), True),
        T.StructField("num_profiles", T.LongType(), True),
        T.StructField("num_pings", T.LongType(), True),
    ] + [T.StructField(n, T.DoubleType(), True) for n in quantile_names("relds", quantiles)]
      + [T.StructField("creation_date", T.DateType(), True)])


def client_means_schema(probes) -> T.StructType:
    return T.StructType([
        T.StructField("client_id", T.StringType(), True),
        T.StructField("app_build_id", T.StringType(), True),
    ] + [T.StructField(p, T.DoubleType(), True) for p in probes]
      + [T.StructField("creation_date", T.DateType(), True)])


PROBE_HISTS = T.StructType([
    T.StructField("app_build_id", T.StringType(), True),
    T.StructField("probe", T.StringType(), True),
    T.StructField("metric", T.IntegerType(), True),
    T.StructField("measure", T.DoubleType(), True),
    T.StructField("creation_date", T.DateType(), True),
])


def relds_measured_schema(probes) -> T.StructType:
    return T.StructType([
        T.StructField("app_build_id", T.StringType(), True),
        T.StructField("rep", T.IntegerType(), True),
    ] + [T.StructField(p, T.DoubleType(), True) for p in probes]
      + [T.StructField("creation_date", T.DateType(), True)])
