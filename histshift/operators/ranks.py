"""Rank index of client means: quantiles, boxes and outliers that read the rows they need.

For each (build, probe) the distinct values are kept in order, each with its count and the number of
values before it, cut into blocks; a directory holds a row per block. A rank is looked up in the
directory and then in the one block that holds it, and so are a box's fences; everything between
them follows from the directory's counts. The index is built once, when a snapshot is published: the
counts are dealt by ranges of (build, probe, value), so that a build with a third of all clients
spans tasks, and the running counts are sums within a task plus the totals of the tasks before it.

Rows of a block share pages of the files (they are sorted, and a page ends at ``BLOCK`` rows), so
that a filter on block numbers reads those pages only. Which blocks those are is known before the
rows are read: at most two a build and rank, named in the query's filter.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histshift.session import write_table
from histshift.sources.published import Change, Store, Version

BLOCK = 4096
#: So many blocks are named in a filter; beyond, the rows meet the blocks in a join alone.
NAMED = 2000
KEYS = ("app_build_id", "probe")
ROWS, BLOCKS, CLIENTS = "rank_rows", "rank_blocks", "rank_clients"
_PAGES = {"parquet.page.row.count.limit": str(BLOCK), "parquet.block.size": str(16 << 20)}


def long_values(means: DataFrame, probes: Iterable[str]) -> DataFrame:
    """(app_build_id, probe, value) of wide client means; NULL and NaN do not take part."""
    probes = list(probes)
    long = means.select("app_build_id", *[F.col(p).cast("double").alias(p) for p in probes]).unpivot(
        ["app_build_id"], probes, "probe", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def rank_rows(values: DataFrame) -> DataFrame:
    """(app_build_id, probe, block, value, c, before): each distinct value, how often it occurs and
    how many values of its (build, probe) are smaller. Block numbers grow with the values."""
    order = [*KEYS, "value"]
    counts = values.groupBy(*order).agg(F.count(F.lit(1)).alias("c"))
    dealt = write_table(counts.repartitionByRange(*order).sortWithinPartitions(*order)
                        .withColumn("_task", F.spark_partition_id()), "rank-counts")
    inside = Window.partitionBy(*KEYS, "_task").orderBy("value")
    rows = dealt.select(*order, "c", "_task", F.row_number().over(inside).alias("_n"),
                        F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    earlier = Window.partitionBy(*KEYS).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*KEYS, "_task").agg(F.sum("c").alias("_c"))          # a row per task and (build, probe)
    totals = totals.select(*KEYS, "_task", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"))
    number = F.col("_task") * F.lit(1 << 32) + F.floor((F.col("_n") - 1) / BLOCK)
    return rows.join(totals, [*KEYS, "_task"]).select(
        *KEYS, number.alias("block"), "value", "c", (F.col("_base") + F.col("_upto") - F.col("c")).alias("before"))


def block_rows(rows: DataFrame) -> DataFrame:
    """The directory: (app_build_id, probe, block, lo, hi, before, n)."""
    return rows.groupBy(*KEYS, "block").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                            F.min("before").alias("before"), F.sum("c").alias("n"))


def stage_index(store: Store, means: DataFrame, probes: Iterable[str]) -> dict[str, Change]:
    """The index of the builds in ``means`` (app_build_id and a column per probe), not yet committed."""
    rows = write_table(rank_rows(long_values(means, probes)), "rank-rows")
    return {ROWS: store.stage(ROWS, rows, sort=("probe", "block", "value"), options=_PAGES),
            BLOCKS: store.stage(BLOCKS, block_rows(rows), sort=("probe", "block")),
            CLIENTS: store.stage(CLIENTS, means.groupBy("app_build_id").agg(F.count(F.lit(1)).alias("num_clients")))}


def directory(version: Version, probe: str, builds: Iterable[str] | None = None) -> DataFrame:
    return version.read(BLOCKS, builds).filter(F.col("probe") == F.lit(probe)).drop("probe")


def _named(wanted: DataFrame) -> Column | None:
    """A filter that names the wanted (build, block) pairs, or None where they are too many."""
    pairs = wanted.select("app_build_id", "block").distinct().limit(NAMED + 1).collect()
    if len(pairs) > NAMED:
        return None
    by_build: dict[str, list[int]] = {}
    for b, k in pairs:
        by_build.setdefault(b, []).append(k)
    tests = [F.col("app_build_id").eqNullSafe(F.lit(b)) & reduce(lambda x, y: x | y, [F.col("block") == k for k in sorted(ks)])
             for b, ks in by_build.items()]
    return reduce(lambda x, y: x | y, tests) if tests else F.lit(False)


def rows_of(version: Version, probe: str, wanted: DataFrame, builds=None) -> DataFrame:
    """The index rows of the wanted (app_build_id, block) pairs, without any other row."""
    rows = version.read(ROWS, builds).filter(F.col("probe") == F.lit(probe)).drop("probe")
    named = _named(wanted)
    if named is not None:
        return rows.filter(named)
    return rows.join(wanted.select("app_build_id", "block").distinct(), ["app_build_id", "block"], "left_semi")


def quantiles(version: Version, probe: str, qs, names, builds: Iterable[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of one probe per build: app_build_id and ``names``."""
    builds = None if builds is None else list(builds)
    blocks = directory(version, probe, builds)
    total = blocks.groupBy("app_build_id").agg(F.sum("n").alias("_n"))
    asked = total.select("app_build_id", F.inline(F.array(*[F.struct(
        F.lit(i).alias("_i"), ((F.col("_n") - 1).cast("double") * F.lit(float(q))).alias("_pos")) for i, q in enumerate(qs)])))
    asked = asked.withColumn("_r0", F.floor("_pos")).withColumn("_r1", F.ceil("_pos"))
    holds = (F.col("before") <= F.col("_r1")) & (F.col("before") + F.col("n") > F.col("_r0"))
    rows = rows_of(version, probe, blocks.join(asked, "app_build_id").filter(holds), builds)
    met = rows.join(asked, "app_build_id").filter((F.col("before") <= F.col("_r1")) & (F.col("before") + F.col("c") > F.col("_r0")))

    def at(rank):
        return F.max(F.when((F.col("before") <= F.col(rank)) & (F.col("before") + F.col("c") > F.col(rank)), F.col("value")))

    found = met.groupBy("app_build_id", "_i").agg(at("_r0").alias("_x0"), at("_r1").alias("_x1"),
                                                  (F.first("_pos") - F.first("_r0")).alias("_f"))
    value = F.col("_x0") + F.col("_f") * (F.col("_x1") - F.col("_x0"))
    return found.groupBy("app_build_id").agg(*[F.max(F.when(F.col("_i") == i, value)).alias(n) for i, n in enumerate(names)])


def group_quantiles(version: Version, probe: str, qs, names, builds=None) -> DataFrame:
    """Quantiles, and ``num_clients`` = all clients of the build, with or without a value."""
    builds = None if builds is None else list(builds)
    return version.read(CLIENTS, builds).join(quantiles(version, probe, qs, names, builds), "app_build_id", "left")


def _fences(version: Version, probe: str, coef: float, builds) -> DataFrame:
    q = quantiles(version, probe, (0.25, 0.5, 0.75), ("lower", "middle", "upper"), builds)
    iqr = F.col("upper") - F.col("lower")
    # a row per build; written, since it is met by the directory and by the rows
    return write_table(q.withColumn("_flo", F.col("lower") - coef * iqr).withColumn("_fhi", F.col("upper") + coef * iqr), "fences")


def box_stats(version: Version, probe: str, coef: float = 1.5, builds: Iterable[str] | None = None) -> DataFrame:
    """Quartiles, whiskers and outlier counts per build. Blocks wholly inside or outside the
    fences count from the directory; only the blocks that a fence cuts are read."""
    builds = None if builds is None else list(builds)
    q = _fences(version, probe, coef, builds)
    blocks = directory(version, probe, builds).join(q, "app_build_id")
    inside = (F.col("lo") >= F.col("_flo")) & (F.col("hi") <= F.col("_fhi"))
    outside = (F.col("hi") < F.col("_flo")) | (F.col("lo") > F.col("_fhi"))
    whole = blocks.filter(inside | outside).select(
        "app_build_id", "n", F.when(inside, F.col("lo")).alias("lo"), F.when(inside, F.col("hi")).alias("hi"),
        F.when(outside, F.col("n")).otherwise(0).alias("out"))
    good = (F.col("value") >= F.col("_flo")) & (F.col("value") <= F.col("_fhi"))
    kept = F.when(good, F.col("value"))
    cut = rows_of(version, probe, blocks.filter(~(inside | outside)), builds).join(q, "app_build_id").select(
        "app_build_id", F.col("c").alias("n"), kept.alias("lo"), kept.alias("hi"), F.when(good, 0).otherwise(F.col("c")).alias("out"))
    agg = whole.unionByName(cut).groupBy("app_build_id").agg(
        F.sum("n").alias("n"), F.min("lo").alias("ymin"), F.max("hi").alias("ymax"), F.sum("out").alias("n_outliers"))
    return q.drop("_flo", "_fhi").join(agg, "app_build_id")


def box_outliers(version: Version, probe: str, coef: float = 1.5, builds: Iterable[str] | None = None) -> DataFrame:
    """(app_build_id, value) of every client mean outside the fences, repeats included."""
    builds = None if builds is None else list(builds)
    q = _fences(version, probe, coef, builds)
    beyond = directory(version, probe, builds).join(q, "app_build_id").filter(
        (F.col("lo") < F.col("_flo")) | (F.col("hi") > F.col("_fhi")))
    rows = rows_of(version, probe, beyond, builds).join(q, "app_build_id").filter(
        (F.col("value") < F.col("_flo")) | (F.col("value") > F.col("_fhi")))
    return rows.select("app_build_id", "value", F.explode(F.sequence(F.lit(1).cast("long"), "c"))).select("app_build_id", "value")
