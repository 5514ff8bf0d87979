"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 3).

``build_index`` centres every vector on the mean, rotates it by a random orthogonal matrix and
keeps one sign bit per dimension (packed), with two correction scalars: its distance from
the centre and the inner product of the code with the vector it stands for. Every row is
indexed; the matrix follows from a seed and the width alone, the centre is one grouped mean.

A search estimates inner products from the bits and the scalars. The estimate's error is at
most ``EPSILON`` * sqrt((1 - f^2) / f^2 / (width - 1)) times both lengths with high
probability (f: the second scalar), so that estimate plus error bounds a score from above.
Vectors are reranked exactly in the order of their upper bounds, until no bound reaches the
k-th exact score; scores are inner products in double precision, summed in order of dimension.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part;
of rows with one ``vec_id`` the least vector counts; shorter vectors end in zeros; a query with
fewer candidates gets them all; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm.common import arrow_rows, bounded_batches, write_table
from histshift.llm.vectors import EVERY, answers, keep_best, matrix, plan, prepared, search

K = 20
EPSILON = 2.6
SEED = 31
QUERY_ROWS = 256
RERANK_ROWS = 64


def rotation(width: int) -> np.ndarray:
    """Random orthogonal matrix of ``SEED`` and the width."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, width]).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, distance from the centre, inner product of code and vector)."""
    r = (x - centre) @ turn
    size = np.linalg.norm(r, axis=1)
    match = np.abs(r).sum(axis=1) / np.maximum(size, 1e-300) / np.sqrt(x.shape[1])
    return np.packbits(r >= 0, axis=1, bitorder="little"), size, np.where(size > 0, match, 1.0)


def signs(codes: np.ndarray, width: int) -> np.ndarray:
    """Packed bits as -1 and 1."""
    return np.unpackbits(codes, axis=1, count=width, bitorder="little").astype(np.float32) * 2 - 1


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in order of dimension."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


def build_index(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray, tuple[int, int]]:
    """(index table: vec_id, embedding, code, size, match; centre; numbers of blocks)."""
    vectors = prepared(embeddings, False)
    width, *blocks = plan(vectors)
    sums = (vectors.select(F.posexplode("embedding").alias("d", "x")).groupBy("d")
            .agg(F.sum(F.col("x").cast("double")).alias("s")).collect())       # one row per dimension
    count = max(vectors.count(), 1)
    centre = np.zeros(width)
    for r in sums:
        centre[r["d"]] = r["s"] / count

    def codes(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, size, match = encode(matrix(pa.chunked_array([batch.column("embedding")]), width), centre, rotation(width))
        return pa.record_batch([batch.column("vec_id"), batch.column("embedding"),
                                pa.array([c.tobytes() for c in code], pa.binary()), pa.array(size), pa.array(match)],
                               names=["vec_id", "embedding", "code", "size", "match"])

    bounded_batches(embeddings.sparkSession)
    kind = vectors.schema["embedding"].dataType.simpleString()
    index = arrow_rows(vectors, codes, f"vec_id long, embedding {kind}, code binary, size double, match double")
    return write_table(index, "index"), centre, tuple(blocks)


def nearest(embeddings: DataFrame, k: int = K, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries ``vec_id % 20 = 0`` against all rows."""
    index, centre, blocks = build_index(embeddings)
    width = len(centre)

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        x, ids = matrix(a.column("embedding"), width), a.column("vec_id").to_numpy()
        packed = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        size, match = a.column("size").to_numpy(), a.column("match").to_numpy()
        bits = (signs(packed, width) * (size / np.maximum(match, 1e-9) / np.sqrt(width))[:, None]).astype(np.float32)
        spread = epsilon * size * np.sqrt(np.maximum(1 - match ** 2, 0) / np.maximum(match ** 2, 1e-9) / max(width - 1, 1))
        offset = x @ centre - centre @ centre
        queries, own = matrix(b.column("embedding"), width), b.column("query_id").to_numpy()
        turn, rows = rotation(width), []
        for at in range(0, len(queries), QUERY_ROWS):
            q = queries[at:at + QUERY_ROWS]
            length = np.linalg.norm(q - centre, axis=1)
            high = (((q - centre) @ turn).astype(np.float32) @ bits.T).astype(np.float64)
            high += offset + (q @ centre)[:, None] + spread * length[:, None]
            for i, me in enumerate(own[at:at + QUERY_ROWS]):
                rows.append((me, *_rerank(x, ids, q[i], high[i], me, k)))
        return answers(rows, pa.float64())

    queries = index.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(index, queries, blocks, tile, k, "double")


def _rerank(x, ids, q, high, me, k) -> tuple[np.ndarray, np.ndarray]:
    """(ids, exact scores): the most promising first, then all whose bound reaches the k-th."""
    first = np.argpartition(-high, min(RERANK_ROWS + k, len(high)) - 1)[:RERANK_ROWS + k]
    first = first[ids[first] != me]
    scores = exact_scores(x[first], q)
    order = keep_best(k, scores, ids[first])
    floor = scores[order[-1]] if len(order) == k else -np.inf
    rest = high >= floor
    rest[first] = False
    rest &= ids != me
    more = np.flatnonzero(rest)
    scores, found = np.concatenate([scores, exact_scores(x[more], q)]), np.concatenate([ids[first], ids[more]])
    order = keep_best(k, scores, found)
    return found[order], scores[order]
