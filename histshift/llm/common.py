"""Helpers shared by the operators: table access, lineage cuts, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histshift.session import write_table

__all__ = ["table", "write_table", "arrow_rows", "text_bytes", "buffers", "int64_of", "slices"]

#: Texts are worked on in slices of about so many bytes, so that a task's arrays stay small.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, *cols: str, text: str = "text") -> DataFrame:
    """``cols`` and the text as UTF-8 bytes in ``_text`` (a null text is empty).

    The row-wise Arrow transfer is cut by bytes, so that a run of very long texts does not
    make one huge batch.
    """
    bounded_batches(df.sparkSession)
    return df.select(*cols, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches sent to Python by rows and bytes (long texts, wide vectors)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def arrow_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
               schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; each call returns one batch."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield fn(b)
    return df.mapInArrow(run, schema)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls, as views where possible."""
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def int64_of(col: pa.Array, fill: int = 0) -> np.ndarray:
    """A long column as numpy; nulls become ``fill``."""
    return col.cast(pa.int64()).fill_null(fill).to_numpy(zero_copy_only=False)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
