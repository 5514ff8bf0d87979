"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "histshift") -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g"))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for lineage cuts and sink round trips.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Where neither is
    set, a session on a ``local`` master gets a folder of its own; any other master raises,
    since a folder of the driver's machine is not visible to its executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        sc = spark.sparkContext
    except Exception as e:     # no local context (e.g. Spark Connect): the conf must name it
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster") from e
    d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="histshift-ckpt-")
        sc.setCheckpointDir(d)
    return d


_JOB_DIR: ContextVar[str | None] = ContextVar("histshift_job_dir", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder (never reused across calls)."""
    base = _JOB_DIR.get() or f"{shared_dir(spark).rstrip('/')}/histshift"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of ``path`` as Spark's JVM sees it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def job_folder(spark: SparkSession, name: str):
    """Tables written inside go to one folder, which is removed at the end: for jobs whose
    outputs are written elsewhere before they return."""
    path = fresh_path(spark, name)
    token = _JOB_DIR.set(path)
    try:
        yield path
    finally:
        _JOB_DIR.reset(token)
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the actions inside; earlier values return at the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: For jobs that collect very many small groups: sorted once, rather than hashed, given up after 128
#: groups and sorted twice. A sort spills, so no size of a task is a question of memory. Rows that
#: are sorted by their keys already are summed as they come, without a hash map.
COLLECTING = {"spark.sql.execution.useObjectHashAggregateExec": "false",
              "spark.sql.execution.replaceHashWithSortAgg": "true"}


def write_table(df, name: str):
    """Cut lineage: write ``df`` as a parquet table under the shared folder and read it
    back. Consumers get compression and column pruning; a lost executor restarts from
    the table instead of recomputing the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
