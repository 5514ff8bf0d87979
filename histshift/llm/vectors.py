"""Shared by the vector searches: clean vectors, and tiles of queries against candidates.

A search compares a stated query set with all rows, block by block: candidates and queries are
dealt by a hash of their id into blocks of bounded bytes, and each (candidate block, query
block) tile is one task's group. Hashing ids keeps blocks even whatever the vectors hold.
A block's task returns its best ``k`` per query; ranks over all blocks follow from those.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histshift.llm.common import write_table

#: Vector components per block (rows of a block = this / width).
BLOCK_COMPONENTS = 1 << 19
EVERY = 20


def clean_vectors(embeddings: DataFrame, zero_too: bool = True) -> DataFrame:
    """(vec_id, embedding) without null ids and without vectors that are null or hold null or
    non-finite components (``zero_too``: zero vectors stay); of rows with one id, the least."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = embeddings.where("vec_id is not null and embedding is not null").where(~bad)
    if not zero_too:
        kept = kept.where(F.exists("embedding", lambda x: x != 0))
    return kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))


def matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """List column as a double matrix; shorter vectors end in zeros."""
    col = col.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as whole numbers in doubles."""
    return np.floor(scale * x)


def big_rows(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers that are too large for sums of products below 2^62."""
    return np.abs(x).max(axis=1, initial=0) > np.sqrt(2.0 ** 62 / max(x.shape[1], 1))


def exact_kind(x: np.ndarray, q: np.ndarray):
    """The fastest number type in which all scores of rows that are not big are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64


def whole_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size; what does not fit a long becomes the nearest long."""
    other = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, other)), -(1 << 63)), (1 << 63) - 1) for row in x.tolist()],
                    np.int64)


def plan(vectors: DataFrame) -> tuple[int, int, int]:
    """(width, candidate blocks, query blocks) of a table of clean vectors."""
    r = vectors.agg(F.max(F.size("embedding")), F.count("*"), F.count(F.when(F.col("vec_id") % EVERY == 0, 1))).first()
    width = max(r[0] or 0, 1)
    rows = max(1, BLOCK_COMPONENTS // width)
    return width, max(1, -(-r[1] // rows)), max(1, -(-r[2] // rows))


def search(candidates: DataFrame, queries: DataFrame, blocks: tuple[int, int],
           tile: Callable[[pa.Table, pa.Table], pa.Table], k: int, score: str) -> DataFrame:
    """Ranks 1 to ``k`` per query: query_id, rank, vec_id, score (ties to the smaller vec_id).

    ``tile(candidates, queries)`` returns (query_id, vec_id, score) of one tile, with at least
    its best ``k`` per query.
    """
    n, m = blocks
    def dealt(df, id_, own, other, count, others):
        return (df.withColumn(own, F.pmod(F.xxhash64(id_), F.lit(count)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))
    left = dealt(candidates, "vec_id", "_c", "_q", n, m)
    right = dealt(queries, "query_id", "_q", "_c", m, n)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.int64() if score == "long" else pa.float64())})
        return tile(a, b)

    found = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(
        run, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def keep_best(k: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indices of the ``k`` best by score, ties to smaller ids, in order."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def answers(rows: list[tuple[int, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Table:
    """Table of (query, ids, scores) lists."""
    ids = [r[1] for r in rows] or [np.zeros(0, np.int64)]
    scores = [r[2] for r in rows] or [np.zeros(0)]
    query = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(np.concatenate(ids), pa.int64()),
                     "score": pa.array(np.concatenate(scores)).cast(kind)})


def prepared(embeddings: DataFrame, zero_too: bool) -> DataFrame:
    return write_table(clean_vectors(embeddings, zero_too), "vectors")
