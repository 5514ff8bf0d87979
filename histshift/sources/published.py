"""Published tables: immutable directories and one commit record that readers resolve (K1-K5).

A version of a store is a record ``_commits/<number>.json`` that names, for each table and each of
its parts (a build, or a run date and a build), the directory that holds it. Writers put new
parts into directories of their own (``stage``) and then add one record (``commit``): all tables
of a run, and the serving snapshots folded from it, become visible together, parts that a run
does not touch keep their files, and readers that resolved an older record go on reading it. A
job that fails before its commit leaves the last whole version; ``vacuum`` removes what no kept
record names.

The record holds names only, about 100 bytes a part; rows never pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histshift.session import hadoop_path

PART = "_part"


class CommitConflict(RuntimeError):
    """Another writer has committed since the version that the changes build on."""


def merged_schema(table: str, old: dict, new: dict) -> dict:
    """Columns of both, by name: a column that a part lacks is NULL there (U2); one whose type
    changes is an error."""
    fields = {f["name"]: f | {"nullable": True} for f in old["fields"]}
    for f in new["fields"]:
        if fields.setdefault(f["name"], f | {"nullable": True})["type"] != f["type"]:
            raise ValueError(f"{table}.{f['name']}: parts that stay have another type")
    return old | {"fields": list(fields.values())}


@dataclass(frozen=True)
class Version:
    """One commit: for each table its schema and its parts (key -> {"path": …, further facts})."""

    spark: SparkSession
    root: str
    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def parts(self, table: str) -> dict[str, dict]:
        return self.tables.get(table, {}).get("parts", {})

    def paths(self, table: str, keys: Iterable[str] | None = None) -> list[str]:
        parts = self.parts(table)
        return [f"{self.root}/{parts[k]['path']}" for k in (parts if keys is None else keys) if k in parts]

    def read(self, table: str, keys: Iterable[str] | None = None) -> DataFrame:
        """The rows of ``table``, of the parts ``keys`` only where given: other parts are not
        even listed. An unknown table is an error, parts that do not exist have no rows."""
        schema = T.StructType.fromJson(self.tables[table]["schema"])
        paths = self.paths(table, keys)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def applied(self, changes: dict[str, "Change"], meta: dict | None = None) -> "Version":
        """This version with ``changes``, not yet committed; readable like any other."""
        tables = dict(self.tables)
        for name, c in changes.items():
            old = tables.get(name, {"parts": {}})
            kept = {k: v for k, v in old["parts"].items() if k not in c.gone and k not in c.parts}
            schema = merged_schema(name, old["schema"], c.schema) if kept else c.schema
            tables[name] = {"schema": schema, "parts": kept | c.parts}
        return replace(self, tables=tables, meta=self.meta | (meta or {}))


@dataclass(frozen=True)
class Change:
    """Parts of one table that are new or replaced, and keys that go."""

    schema: dict
    parts: dict[str, dict]
    gone: frozenset[str] = frozenset()


class Store:
    """Versioned tables below ``root``, any folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self) -> list[str]:
        fs, p = hadoop_path(self.spark, f"{self.root}/_commits")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _load(self, name: str) -> Version | None:
        fs, p = hadoop_path(self.spark, f"{self.root}/_commits/{name}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            r = json.loads(text)
        except ValueError:
            return None                     # cut short by a store without an atomic rename
        return Version(self.spark, self.root, int(name[:-5]), r["tables"], r["meta"])

    def current(self) -> Version:
        """The last whole commit; a store without any is an empty version 0."""
        for name in reversed(self._commits()):
            v = self._load(name)
            if v is not None:
                return v
        return Version(self.spark, self.root)

    def stage(self, table: str, df: DataFrame, by: str = "app_build_id", prefix: str = "", sort=(),
              options: dict | None = None, **facts) -> Change:
        """Write ``df`` as new parts of ``table``, one per value of ``by``, in one job; nothing
        sees them before a commit. Small parts share a task, a large one is split by size; rows of
        a file are in the order of ``sort``."""
        rel = f"data/{table}/{uuid.uuid4().hex}"
        out = df.withColumn(PART, F.col(by).cast("string"))
        if self.spark.conf.get("spark.sql.adaptive.enabled", "true") == "true":
            out = out.hint("rebalance", PART)
        if sort:
            out = out.sortWithinPartitions(PART, *sort)
        out.write.options(**(options or {})).partitionBy(PART).parquet(f"{self.root}/{rel}")
        fs, p = hadoop_path(self.spark, f"{self.root}/{rel}")
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return Change(df.schema.jsonValue(), {prefix + unquote(n.partition("=")[2]): {"path": f"{rel}/{n}", **facts}
                                              for n in names if n.startswith(f"{PART}=")})

    def commit(self, base: Version, changes: dict[str, Change], meta: dict | None = None) -> Version:
        """Make ``changes`` on top of ``base`` visible at once, by renaming one record into place."""
        new = replace(base.applied(changes, meta), number=base.number + 1)
        fs, tmp = hadoop_path(self.spark, f"{self.root}/_commits/.{uuid.uuid4().hex}")
        stream = fs.create(tmp, False)
        try:
            stream.write(json.dumps({"tables": new.tables, "meta": new.meta}).encode())
        finally:
            stream.close()
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits/{new.number:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(),
                                                                      self.spark._jsc.hadoopConfiguration())
        options = jvm.java.lang.reflect.Array.newInstance(
            jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(target), options)    # fails where the target exists
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {new.number} of {self.root} exists") from e
            raise
        return new

    def publish(self, frames: dict[str, DataFrame], by: str = "app_build_id") -> Version:
        """Replace whole tables by ``frames``, in one commit."""
        base = self.current()
        changes = {}
        for name, df in frames.items():
            c = self.stage(name, df, by)
            changes[name] = replace(c, gone=frozenset(base.parts(name)) - frozenset(c.parts))
        return self.commit(base, changes)

    def vacuum(self, keep: int = 2) -> int:
        """Remove directories that none of the last ``keep`` commits names, and older records;
        not while a writer is at work. Returns the number of directories removed."""
        names = self._commits()
        kept = [v for n in names[-keep:] if (v := self._load(n)) is not None]
        used = {x["path"] for v in kept for t in v.tables.values() for x in t["parts"].values()}
        fs, root = hadoop_path(self.spark, f"{self.root}/data")
        removed = 0

        def clean(path, rel):
            """Whether nothing below ``path`` is in use."""
            nonlocal removed
            if rel in used:
                return False
            below = [s for s in fs.listStatus(path) if s.isDirectory()]
            free = [clean(s.getPath(), f"{rel}/{s.getPath().getName()}") for s in below]
            if all(free):
                return True
            for s, f in zip(below, free):
                if f:
                    fs.delete(s.getPath(), True)
                    removed += 1
            return False

        if fs.exists(root) and kept:
            clean(root, "data")
            for n in names[:-keep]:
                fs.delete(hadoop_path(self.spark, f"{self.root}/_commits/{n}")[1], False)
        return removed
