"""Adapters from the driver's test tables to the ping table T1 (FIXTURES A and B).

The reference reads a telemetry table with one histogram map per probe. The test data
has no such table, so these adapters derive one with plain aggregations; everything
downstream consumes only the T1 schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of adapter A: the event types become the probes, in this order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_PROBES = tuple(f"hist_{t}" for t in EVENT_TYPES)
# Adapter B probes.
LINEITEM_PROBES = ("hist_quantity", "hist_price", "hist_discount", "hist_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _keyed_map(rows: str, key: str):
    """The map of one key among the collected (key, bin, n) of a ping; NULL without any."""
    own = F.filter(rows, lambda r: r["key"] == F.lit(key))
    return F.when(F.size(own) > 0, F.map_from_entries(F.transform(own, lambda r: F.struct(r["bin"], r["n"]))))


def _summed_map(rows: str, name: str):
    """The map of one bin column among the collected (bins…, n) of a ping: n summed per bin. Most
    pings have one row, which needs no lambda."""
    def total(b):
        return F.aggregate(F.filter(rows, lambda r: r[name] == b), F.lit(0).cast("bigint"), lambda a, r: a + r["n"])
    bins = F.array_distinct(F.transform(rows, lambda r: r[name]))
    several = F.map_from_entries(F.transform(bins, lambda b: F.struct(b.alias("bin"), total(b).alias("n"))))
    one = F.get(rows, F.lit(0))
    return F.when(F.size(rows) == 1, F.create_map(one[name], one["n"])).otherwise(several)


def events_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: one ping = one user in one hour; ``hist_<event_type>`` maps
    floor(value/5)*5 to the number of events of that type in the ping."""
    ev = table(spark, sf_dir, "events").select(
        "user_id",
        F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHHmmss").alias("app_build_id"),
        F.col("event_type").alias("key"),
        (F.floor(F.col("value") / 5) * 5).cast("int").alias("bin"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    # two-level aggregation: counts per bin first (partial aggregation absorbs hot users)
    per_bin = ev.groupBy("user_id", "app_build_id", "key", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    pings = per_bin.select("user_id", "app_build_id", "k", F.struct("key", "bin", "n").alias("_row")).groupBy(
        "user_id", "app_build_id").agg(F.max("k").alias("max_k"), F.collect_list("_row").alias("_rows"))
    uid = F.col("user_id")
    return pings.select(
        uid.cast("string").alias("client_id"),
        "app_build_id",
        F.when(uid % 50 == 49, F.lit("other")).otherwise(F.lit("app")).alias("app_name"),
        F.when(F.col("max_k") % 10 < 9, F.lit("nightly")).otherwise(F.lit("beta"))
         .alias("normalized_channel"),
        (uid % 100).cast("string").alias("sample_id"),
        *[_keyed_map("_rows", t).alias(p) for t, p in zip(EVENT_TYPES, EVENT_PROBES)],
    )


def lineitem_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B (scale): one ping = one customer in one ship month."""
    day = F.date_format(F.trunc(F.col("l_shipdate").cast("date"), "month"), "yyyyMMdd")
    bins = {
        "hist_quantity": (F.floor(F.col("l_quantity") / 5) * 5).cast("int"),
        "hist_price": (F.floor(F.col("l_extendedprice") / 5000) * 5000).cast("int"),
        "hist_discount": F.round(F.col("l_discount") * 100).cast("int"),
        "hist_tax": F.round(F.col("l_tax") * 100).cast("int"),
    }
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("_day"), *[c.alias(p) for p, c in bins.items()])
    od = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"))
    # lines are dealt by ping once, as a row of bins. There lines with the same four bins are counted
    # first: a ping then collects at most one row per combination of bins, and one row per line at most
    lines = li.join(od, li.l_orderkey == od.o_orderkey).select("cust", "_day", *bins).repartition("cust", "_day")
    counted = lines.groupBy("cust", "_day", *bins).agg(F.count(F.lit(1)).alias("n"))
    pings = counted.select("cust", "_day", F.struct(*bins, "n").alias("_row")).groupBy("cust", "_day").agg(
        F.collect_list("_row").alias("_rows")).withColumn("app_build_id", F.concat("_day", F.lit("120000")))
    return pings.select(
        F.col("cust").cast("string").alias("client_id"),
        "app_build_id",
        F.lit("app").alias("app_name"),
        F.lit("nightly").alias("normalized_channel"),
        (F.col("cust") % 100).cast("string").alias("sample_id"),
        *[_summed_map("_rows", p).alias(p) for p in LINEITEM_PROBES],
    )
