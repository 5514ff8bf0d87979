"""Readers: ping table, CSV part directories, JSON histograms, parquet snapshots."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histshift.functions.dates import BUILD_DAY
from histshift.session import hadoop_path, settings
from histshift.sources.published import Store
from histshift.sources.sinks import SNAPSHOT


def read_pings(spark: SparkSession, source: str) -> DataFrame:
    """A catalog table name or a parquet path holding T1, plain or by build day
    (``sinks.write_pings``); a build day is read as the text it is, not as a number."""
    if "/" not in source and not source.endswith(".parquet"):
        return spark.table(source)
    pings = spark.read.parquet(source)
    if BUILD_DAY in pings.columns and pings.schema[BUILD_DAY].dataType != T.StringType():
        fields = [T.StructField(f.name, T.StringType() if f.name == BUILD_DAY else f.dataType, True) for f in pings.schema]
        pings = spark.read.schema(T.StructType(fields)).parquet(source)
    return pings


def _csv_runs(spark: SparkSession, path: str) -> list[str]:
    """The run directories (``name=value``) below ``path``, or ``path`` itself."""
    fs, p = hadoop_path(spark, path)
    runs = sorted(s.getPath().toString() for s in fs.listStatus(p)
                  if s.isDirectory() and "=" in s.getPath().getName())
    return runs or [path]


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one split's lines: the first that isn't blank; the rest isn't read."""
    for batch in batches:
        for k, line in enumerate(batch.column("value").to_pylist()):
            if line.strip():
                yield batch.slice(k, 1)
                return


def header_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, dir, header) of every CSV part below ``path`` that holds a line.

    One job over all parts, whatever their number of run directories: every split is a task of
    its own, which stops after its first lines. To be collected under ``_ONE_FILE_A_TASK``."""
    lines = (spark.read.option("recursiveFileLookup", True).text(_csv_runs(spark, path))
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))
    first = lines.where("start = 0").mapInArrow(_first_lines, "value string, file string, start long")
    return first.select("file", F.regexp_replace("file", "/[^/]*$", "").alias("dir"), F.col("value").alias("header"))


#: Files aren't packed into shared tasks (opening one counts as a whole split), and a task asks
#: for a few lines at a time.
_ONE_FILE_A_TASK = {"spark.sql.files.maxPartitionBytes": "128MB", "spark.sql.files.openCostInBytes": "128MB",
                    "spark.sql.files.maxPartitionNum": str(2 ** 31 - 1), "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}


def _parts_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Paths by column names: run directories, or single parts where a run's parts differ."""
    index = header_index(spark, path).groupBy("dir").agg(
        F.collect_set("header").alias("headers"), F.collect_list(F.struct("header", "file")).alias("parts"))
    mixed = F.size("headers") > 1
    with settings(spark, _ONE_FILE_A_TASK):     # a row per run directory; file names only where its parts differ
        found = index.select("dir", "headers", F.when(mixed, F.col("parts")).alias("parts")).orderBy("dir").collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for r in found:
        for header, where in ([(p.header, p.file) for p in sorted(r.parts)] if r.parts else [(r.headers[0], r.dir)]):
            names = tuple(next(csv.reader([header.removeprefix("\ufeff")])))
            if len(set(names)) < len(names):
                raise ValueError(f"columns {list(names)} repeat in {unquote(where)}")
            out.setdefault(names, []).append(unquote(where))
    return out


def read_csv_parts(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Every CSV part under ``path``, each by its own header, also where the parts of
    one run (``creation_date=…`` directory) differ. Columns are matched by name and cast to
    ``schema``: one that a part lacks is NULL (the probe list changed), or an error when
    ``strict``, as is one too many; otherwise further columns are left out. A value that doesn't
    parse fails the read, as does a name that a header holds twice; a header is one line. Parts
    with the same header are one scan; Spark skips ``_*`` and ``.*`` files."""
    frames = []
    for header, paths in _parts_by_header(spark, path).items():
        raw = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
        df = (spark.read.schema(raw).option("header", True).option("enforceSchema", False)
              .option("mode", "FAILFAST").option("basePath", path).csv(paths))
        lacking = [f.name for f in schema.fields if f.name not in df.columns]
        if strict and (lacking or set(df.columns) - set(schema.names)):
            raise ValueError(f"columns {df.columns} are not {schema.names} in {paths}")
        frames.append(df.select(*[(F.lit(None) if f.name in lacking else F.col(f"`{f.name}`"))
                                  .cast(f.dataType).alias(f.name) for f in schema.fields]))
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b), frames)


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Q26: a NULL in ``cols`` fails the query instead of passing through running sums."""
    for c in cols:
        missing = F.raise_error(F.lit(f"{c} must not be NULL")).cast(df.schema[c].dataType)
        df = df.withColumn(c, F.coalesce(F.col(c), missing))
    return df


HIST_JSON = T.StructType([
    T.StructField("app_build_id", T.StringType(), True),
    T.StructField("probe", T.StringType(), True),
    T.StructField("hist", T.MapType(T.StringType(), T.DoubleType()), True),
])


def read_json_hists(spark: SparkSession, path: str) -> DataFrame:
    """JSON histogram records (bin keys are strings in JSON) back to long rows."""
    raw = spark.read.schema(HIST_JSON).json(path)
    typed = raw.select("app_build_id", "probe",
                       F.transform_keys("hist", lambda k, v: k.cast("int")).alias("hist"))
    return typed.select("app_build_id", "probe", F.explode("hist").alias("metric", "measure"))


def parse_hist_json(col: str) -> F.Column:
    """A JSON object text {"bin": count, …} to map<int,bigint> (from_json accepts only
    string keys, so keys are cast afterwards)."""
    m = F.from_json(F.col(col), "map<string,bigint>")
    return F.transform_keys(m, lambda k, v: k.cast("int"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A published snapshot, as of its last whole commit; or a plain parquet directory."""
    version = Store(spark, path).current()
    return version.read(SNAPSHOT) if version.number else spark.read.parquet(path)


def probe_dim(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """(label, probe) lookup table; a handful of rows."""
    pairs = [F.struct(F.lit(k).alias("label"), F.lit(v).alias("probe")) for k, v in mapping.items()]
    return spark.range(1).select(F.inline(F.array(*pairs)))
