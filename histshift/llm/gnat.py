"""Hard-negative mining by a multiway hyperplane tree (operator 13).

Every component x becomes floor(256 * x); a row's score for an anchor is the integer inner product.
An anchor's positives are its best rows of the same label; for each positive, its hard negatives
are the best rows of other labels whose score lies in a window below the positive's.

Rows become points of a metric space by one more coordinate, sqrt(M^2 - |x|^2) (M: the greatest
length), an anchor by a zero there: then distance^2 = |a|^2 + M^2 - 2 * score, and a window of
scores is an annulus of distances around the anchor. A node of the tree holds up to ``ARITY``
split points; each row below it goes with its nearest split point. For every split point i the
node stores the range of distances from it to the rows of each sibling subtree j. A window with
the annulus [inner, outer] around an anchor at distance d from i can only hold rows whose distance
from i lies in [max(d - outer, inner - d), d + outer]; where that interval misses the stored range,
subtree j is eliminated. Leaves are scored exactly. Once a window has its k rows, its lower end
rises to the k-th score, so that the annulus shrinks.

Rows are dealt by a hash of their id into blocks of bounded size, a tree each; anchors meet the
blocks in tiles. For positives the blocks are those of the anchor's label, as many as its rows
fill, so a label with a third of all rows is many blocks; for negatives they mix all labels.

Defined cases: rows with a null id or label, a null vector or a null or non-finite component take
no part; of rows with one ``vec_id`` the least (label, vector) counts; vectors of different widths
are compared over the shorter one; scores that do not fit a long count as the nearest long;
an anchor with fewer positives or a window with fewer rows returns them all; an anchor without
another row of its label returns nothing; ties go to the smaller id; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histshift.llm import vectors as V
from histshift.llm.common import write_table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
ARITY, LEAF = 16, 64
#: Windows walked down a tree together; bounds the arrays of a step.
BATCH = 1024
SEED = 13
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Node:
    """Rows of a leaf, or split points with the ranges of distances to each subtree."""
    __slots__ = ("rows", "points", "near", "far", "children")

    def __init__(self, rows):
        self.rows, self.points, self.near, self.far, self.children = rows, None, None, None, None


class Tree:
    """A block's rows as a multiway hyperplane tree; ``x`` holds integers, exact in its type."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.x, self.ids, self.labels = x, ids, labels
        wide = x.astype(np.float64)
        self.length2 = (wide * wide).sum(axis=1)
        self.most2 = float(self.length2.max(initial=0))
        self.lift = np.sqrt(self.most2 - self.length2)
        self.slack = 1e-6 * np.sqrt(self.most2) + 1e-9     # more than distances can be off by rounding
        self.rng = np.random.default_rng(SEED)
        self.scored = 0      # row and anchor pairs scored at leaves
        self.root = self._build(np.arange(len(x)))

    def _distances(self, rows: np.ndarray, point: int) -> np.ndarray:
        d2 = self.length2[rows] + self.length2[point] - 2.0 * (self.x[rows] @ self.x[point]).astype(np.float64)
        return np.sqrt(np.maximum(d2 + (self.lift[rows] - self.lift[point]) ** 2, 0))

    def _build(self, rows: np.ndarray) -> Node:
        node = Node(rows)
        if len(rows) <= LEAF:
            return node
        # split points far apart, each the farthest of a sample from those before it
        sample = rows[self.rng.choice(len(rows), min(len(rows), 4 * ARITY), replace=False)]
        points = [int(sample[0])]
        nearest = self._distances(sample, points[0])
        while len(points) < min(ARITY, len(sample)) and nearest.max() > self.slack:
            points.append(int(sample[nearest.argmax()]))
            nearest = np.minimum(nearest, self._distances(sample, points[-1]))
        if len(points) == 1:
            return node                                     # copies of one vector
        far = np.stack([self._distances(rows, p) for p in points])
        own = far.argmin(axis=0)
        parts = [np.flatnonzero(own == j) for j in range(len(points))]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:
            return node
        node.rows, node.points = None, np.array(points)
        node.near = np.stack([far[:, p].min(axis=1) for p in parts], axis=1)      # split point by subtree
        node.far = np.stack([far[:, p].max(axis=1) for p in parts], axis=1)
        node.children = [self._build(rows[p]) for p in parts]
        return node

    def best(self, q: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray,
             vector: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``x``, scores), windows by k: each window's best rows with low <= score <= high.

        ``q``, ``own`` and ``labels`` are the anchors' vectors, ids and labels; ``vector`` names the
        anchor of each window. ``same``: rows of the anchor's label, else of others. -1: none left.
        """
        n = len(vector)
        rows_of, scores = np.full((n, k), -1, np.int64), np.full((n, k), _LEAST, np.int64)
        wide = q.astype(np.float64)
        base = (wide * wide).sum(axis=1) + self.most2

        def leaf(rows, at):
            for i in range(0, len(rows), 4 * LEAF):
                part = rows[i:i + 4 * LEAF]
                who, place = np.unique(vector[at], return_inverse=True)
                s = (q[who] @ self.x[part].T).astype(np.int64)
                self.scored += s.size
                good = ((labels[who][:, None] == self.labels[part]) == same) & (own[who][:, None] != self.ids[part])
                s, good = s[place], good[place]
                good &= (s >= np.maximum(low[at], scores[at, -1])[:, None]) & (s <= high[at][:, None])
                some = np.flatnonzero(good.any(axis=1))
                if not len(some):
                    continue
                w = at[some]
                cand = np.concatenate([rows_of[w], np.where(good[some], part, -1)], axis=1)
                val = np.concatenate([scores[w], np.where(good[some], s[some], _LEAST)], axis=1)
                # best score first, then the smaller id; a real row before an empty place
                order = np.lexsort((self.ids[cand], cand < 0, ~val), axis=1)[:, :k]
                rows_of[w], scores[w] = np.take_along_axis(cand, order, 1), np.take_along_axis(val, order, 1)

        def walk(node, at):
            if node.rows is not None:
                leaf(node.rows, at)
                return
            who, place = np.unique(vector[at], return_inverse=True)
            d = np.sqrt(np.maximum(base[who][:, None] - 2.0 * (q[who] @ self.x[node.points].T), 0))
            order = np.argsort(d.mean(axis=0)[:len(node.children)])
            d = d[place]
            for j in order:
                floor = np.maximum(low[at], scores[at, -1]).astype(np.float64)
                b = base[vector[at]]
                outer = np.sqrt(np.maximum(b - 2.0 * floor, 0)) + self.slack
                inner = np.sqrt(np.maximum(b - 2.0 * high[at].astype(np.float64), 0)) - self.slack
                least = np.maximum(d - outer[:, None], inner[:, None] - d)
                alive = ((node.near[:, j] <= d + outer[:, None]) & (node.far[:, j] >= least)).all(axis=1)
                if alive.any():
                    walk(node.children[j], at[alive])

        if len(self.x):
            for i in range(0, n, BATCH):
                walk(self.root, np.arange(i, min(i + BATCH, n)))
        return rows_of, scores


def _among(x, ids, labels, q, own, qlabels, low, high, vector, same, k) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(window, ids, scores): the k best of each window in one block. Rows and anchors whose
    products could pass 2^62 are scored one by one in whole numbers, the others by the tree."""
    big, large = V.big_rows(x), V.big_rows(q)
    plain = ~big
    kind = V.exact_kind(x[plain], q[~large])
    tree = Tree(x[plain].astype(kind), ids[plain], labels[plain])
    small = np.flatnonzero(~large[vector])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(vector)
    best = tree.best(np.where(large[:, None], 0, q).astype(kind), own, qlabels, low[small], high[small], vector[small], same, k)
    for w, i, s in zip(small, *best):
        found[w] = (tree.ids[i[i >= 0]], s[i >= 0])
    out = []
    for w, (i, s) in enumerate(found):
        a = vector[w]
        rest = np.ones(len(x), bool) if large[a] else big
        if rest.any():
            more, value = ids[rest], V.whole_scores(x[rest], q[a])
            good = ((labels[rest] == qlabels[a]) == same) & (more != own[a]) & (value >= low[w]) & (value <= high[w])
            i, s = np.concatenate([i, more[good]]), np.concatenate([s, value[good]])
            order = np.lexsort((i, ~s))[:k]
            i, s = i[order], s[order]
        if len(i):
            out.append((w, i, s))
    return out


def _renamed(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that both sides of a tile may come from one table."""
    return df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])


def _dealt(df: DataFrame, id_: str, own: str, other: str, count: Column, others: Column) -> DataFrame:
    return (df.withColumn(own, F.pmod(F.xxhash64(id_), count).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), others.cast("int") - 1))))


def clean_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(~bad)
    row = F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("_r")
    return kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(row).select("vec_id", "_r.label", "_r.embedding")


def positives(rows: DataFrame, anchors: DataFrame, width: int, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, vec_id, score): each anchor's ``k`` best other rows of its label."""
    block = max(1, V.BLOCK_COMPONENTS // width)
    per = (rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
           .join(anchors.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("m")), "label"))
    per = write_table(per, "blocks")
    left = _dealt(rows.join(per, "label"), "vec_id", "_c", "_q", F.col("n"), F.col("m"))
    right = _renamed(_dealt(anchors.join(per, "label"), "vec_id", "_q", "_c", F.col("m"), F.col("n")))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return V.answers([], pa.int64())
        x, q = (V.integers(V.matrix(c, width), SCALE) for c in (a.column("embedding"), b.column("a_embedding")))
        own, label = b.column("a_vec_id").to_numpy(), b.column("a_label").to_numpy()
        n = len(own)
        found = _among(x, a.column("vec_id").to_numpy(), a.column("label").to_numpy(), q, own, label,
                       np.full(n, _LEAST), np.full(n, _MOST), np.arange(n), True, k)
        return V.answers([(own[w], i, s) for w, i, s in found], pa.int64())

    keys = ("label", "_c", "_q")
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"a_{c}" for c in keys])).applyInArrow(tile, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
            .select(F.col("query_id").alias("anchor_id"), "vec_id", "score"))


def negatives(rows: DataFrame, anchors: DataFrame, found: DataFrame, width: int, k: int = NEGATIVES,
              low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each positive
    in ``found`` the ``k`` best rows of other labels with low % <= score / positive score <= high %."""
    block = max(1, V.BLOCK_COMPONENTS // width)
    windows = found.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("windows"))
    asked = write_table(anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "anchors")
    n, m = (F.lit(max(1, -(-df.count() // block))) for df in (rows, asked))
    left, right = _dealt(rows, "vec_id", "_c", "_q", n, m), _renamed(_dealt(asked, "vec_id", "_q", "_c", m, n))
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        lists = b.column("a_windows").combine_chunks() if b.num_rows else None
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        x, q = (V.integers(V.matrix(c, width), SCALE) for c in (a.column("embedding"), b.column("a_embedding")))
        own, vector = b.column("a_vec_id").to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        positive, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "score"))
        least = np.array([-(-low * int(s) // 100) for s in value], np.int64)      # whole numbers: no rounding, no overflow
        most = np.array([high * int(s) // 100 for s in value], np.int64)
        hits = _among(x, a.column("vec_id").to_numpy(), a.column("label").to_numpy(), q, own, b.column("a_label").to_numpy(),
                      least, most, vector, False, k)
        which = np.repeat(np.array([w for w, *_ in hits], np.int64), [len(i) for _, i, _ in hits])
        empty = [np.zeros(0, np.int64)]
        return pa.table([own[vector[which]], positive[which], value[which], np.concatenate([i for _, i, _ in hits] or empty),
                         np.concatenate([s for *_, s in hits] or empty)], names=names)

    out = left.groupBy("_c", "_q").cogroup(right.groupBy("a__c", "a__q")).applyInArrow(tile, ", ".join(f"{c} long" for c in names))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, is_anchor: Column) -> DataFrame:
    """Mine every anchor of ``embeddings`` (vec_id, label, embedding); ``is_anchor`` is a condition
    on its rows."""
    rows = write_table(clean_rows(embeddings), "vectors")
    width = max(rows.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    anchors = rows.where(is_anchor)
    found = write_table(positives(rows, anchors, width), "positives")
    return negatives(rows, anchors, found, width)


def shifted_labels(embeddings: DataFrame) -> DataFrame:
    """The query's labels: where ``vec_id`` is divisible by 7, the next one of ten."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
                                 .otherwise(F.col("label")))
