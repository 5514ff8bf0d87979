"""Exact top-k search by the threshold algorithm (operator 1).

Every component x becomes floor(64 * x), and the score is the integer inner product. Each
candidate block keeps one sorted list per dimension. For a query the lists are read in step,
from the high end where the query's component is positive and from the low end where it is
negative. Each newly met vector is scored in full; the bound, the inner product of the query
with the values last read from the lists, is the most an unmet vector can score. Reading
stops when the bound cannot beat the k-th best score (an equal one could still win its tie by
id), or when every vector has been met. Depths double, so that a step is a few array operations.

Defined cases: vectors that are null or hold null or non-finite components take no part; of
rows with one ``vec_id`` the least vector counts; vectors of different widths are compared
over the shorter one; components may have any finite size (products that could pass 2^62 are taken
in whole numbers outside the lists); scores that do not fit a long count as the nearest long;
a query with fewer candidates gets them all; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm.vectors import (EVERY, answers, big_rows, exact_kind, integers, keep_best, matrix, plan, prepared,
                                   search, whole_scores)

SCALE, K = 64, 20
FIRST_DEPTH = 256


class SortedLists:
    """One block: integer vectors and, for each dimension, their order by that component."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32).copy()     # dimension by place
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        self.scored = 0     # full scores taken so far, over all queries

    def top(self, q: np.ndarray, ids: np.ndarray, own: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best vectors but ``own``."""
        n = len(self.x)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        met = np.zeros(n, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        last, depth = 0, FIRST_DEPTH
        while True:
            depth = min(depth, n)
            if len(up) + len(down) and depth < n:
                new = np.zeros(n, bool)
                new[self.order[up, n - depth:n - last]] = True
                new[self.order[down, last:depth]] = True
                new &= ~met
                at = np.flatnonzero(new)
                met |= new
            else:
                at, depth = np.flatnonzero(~met), n
                met[:] = True
            # for most of the block one product over all of it is faster than a gather
            most = 2 * len(at) > n
            scores, found = (self.x @ q)[at] if most else self.x[at] @ q, ids[at]
            self.scored += n if most else len(at)
            if len(best) == k:
                good = scores >= best[-1]
                scores, found = scores[good], found[good]
            other = found != own
            best, best_ids = np.concatenate([best, scores[other]]), np.concatenate([best_ids, found[other]])
            order = keep_best(k, best, best_ids)
            best, best_ids = best[order], best_ids[order]
            if depth == n or met.all():
                return best_ids, best
            bound = self.values[up, n - depth] @ q[up] + self.values[down, depth - 1] @ q[down]
            if len(best) == k and bound < best[-1]:
                return best_ids, best
            last, depth = depth, 2 * depth


def best_of_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int = K) -> list[tuple]:
    """(own, ids, scores) of every query: ordinary rows by the sorted lists, big ones one by one."""
    big, large = big_rows(x), big_rows(q)
    kind = exact_kind(x[~big], q[~large])
    lists, plain = SortedLists(x[~big].astype(kind)), ids[~big]
    out = []
    for v, me, hard in zip(q, own, large):
        found, scores = (plain[:0], np.zeros(0, np.int64)) if hard or not len(plain) else lists.top(v.astype(kind), plain, me, k)
        rest = (big | hard) & (ids != me)
        if rest.any():
            found = np.concatenate([found, ids[rest]])
            scores = np.concatenate([scores.astype(np.int64), whole_scores(x[rest], v)])
            order = np.lexsort((found, ~scores))[:k]
            found, scores = found[order], scores[order]
        out.append((me, found, scores.astype(np.int64)))
    return out


def top_k(embeddings: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries ``vec_id % 20 = 0`` against all rows."""
    vectors = prepared(embeddings, True)
    width, *blocks = plan(vectors)

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        x, q = integers(matrix(a.column("embedding"), width), SCALE), integers(matrix(b.column("embedding"), width), SCALE)
        return answers(best_of_block(x, a.column("vec_id").to_numpy(), q, b.column("query_id").to_numpy(), k), pa.int64())

    queries = vectors.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return search(vectors, queries, tuple(blocks), tile, k, "long")
