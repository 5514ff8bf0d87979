"""Quality classifier: naive Bayes support vectors (operator 4).

A text's features are indicators of its byte n-grams (lengths ``LENGTHS``), hashed to
``2 ** BITS`` places, and, in a block of their own, of word patterns: the size class of its
word count and of the share of bigrams that hold one word twice. Each indicator is scaled by
the log-count ratio of the classes (naive Bayes), each block to unit length, and a linear model is fitted under hinge loss by dual
coordinate descent; its weights are interpolated with their mean magnitude. A sigmoid fitted
on margins of texts that the model had not seen turns margins into scores.

The model is fitted on a bounded sample, ``PER_CLASS`` labelled texts of either class at most
(those whose ids have the least hash, one text of each id: that of the least hash), and of these,
in the same order, as many as have ``CLASS_BYTES`` of features; class shares, which set the
sigmoid, are counted over all labels. The ids of the sample are bounded likewise and so are
broadcast; its features meet in one task and the model (a few MB, whatever the input) is the
only thing that reaches the driver. Scoring reads every whole text and shuffles nothing.

Labels come only from rows whose ``crc32(doc_id as text) mod 5`` is not 0. Defined cases: null
texts count as empty; labels that are null, or whose ``doc_id`` is null, teach nothing, and
those without a text only count in the class shares; of several labels of one ``doc_id`` the
larger counts, and of several texts one teaches; where a class has no labels the score is
the share of the other class (0.5 without labels); ``held_out`` of a null ``doc_id`` is false;
equal rows get equal scores; further columns are kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histshift.llm import words as W
from histshift.llm.common import arrow_rows, buffers, text_bytes, write_table

BITS = 18
LENGTHS = (1, 2, 3, 4)
PER_CLASS = 3000
#: Bytes of features of a class, 4 a distinct place: more than 3,000 texts of 20,000 places each have.
CLASS_BYTES = 256 << 20
SMOOTH, COST, BETA, EPOCHS, TOLERANCE = 1.0, 10.0, 0.25, 30, 0.02
FOLDS = 3
#: Places of word patterns, after those of n-grams: size classes of words, then of repeats.
PLACES = (1 << BITS) + 32
THRESHOLD = 0.3


class Features:
    """Distinct feature places of texts; a bit map per instance replaces sorting."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def places(self, text: np.ndarray) -> np.ndarray:
        """Sorted distinct places of the n-grams of ``text`` (UTF-8 bytes), of any length."""
        shift = np.uint32(32 - BITS)
        for at in range(0, len(text), 1 << 20):
            t = text[at:at + (1 << 20) + max(LENGTHS) - 1].astype(np.uint32)
            gram = np.zeros(len(t), np.uint32)
            for n in range(1, max(LENGTHS) + 1):
                gram = (gram[:len(t) - n + 1] << np.uint32(8)) | t[n - 1:] if n <= len(t) else gram[:0]
                if n in LENGTHS:
                    self.seen[((gram + np.uint32(n)) * np.uint32(2654435761) >> shift).astype(np.int64)] = True
        out = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[out] = False
        return np.concatenate([out, self.patterns(text)])

    @staticmethod
    def patterns(text: np.ndarray) -> np.ndarray:
        starts, ends, _ = W.bounds(text, np.array([0, len(text)]))
        h = W.hashes(text, starts, ends)
        twice = int((h[1:] == h[:-1]).sum())
        share = 0 if not twice else 1 + min(int(-np.log2(twice / len(h))), 14)
        return np.array([min(len(h).bit_length(), 15), 16 + share], np.int32) + np.int32(1 << BITS)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = {s: np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == s] or [np.zeros(0, np.int64)]),
                             minlength=PLACES) + SMOOTH for s in (1, -1)}
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def dual_coordinate_descent(rows, values, y, cost, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of min 1/2 |w|^2 + sum cost_i * hinge_i (the bias is a feature
    of value 1)."""
    w, bias = np.zeros(PLACES), 0.0
    alpha, square = np.zeros(len(rows)), np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            step = min(max(alpha[i] - g / square[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                worst = max(worst, abs(step) * square[i])
        if worst < TOLERANCE:
            break
    return w, bias, alpha


def _model(rows, y) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight per place, squared ratio per place, bias)."""
    ratio = log_count_ratio(rows, y)
    values = [ratio[r] / lengths(r, ratio ** 2) for r in rows]
    share = (y == 1).mean()
    cost = COST * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, bias, _ = dual_coordinate_descent(rows, values, y, cost)
    w = (1 - BETA) * np.abs(w[w != 0]).mean() * (w != 0) + BETA * w
    return (w * ratio).astype(np.float32), (ratio ** 2).astype(np.float32), float(bias)


def lengths(places: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """What each place's value is divided by: the length of its block of the text."""
    grams, found = int(np.searchsorted(places, 1 << BITS)), squares[places].astype(np.float64)
    size = np.sqrt([found[:grams].sum(), found[grams:].sum()])
    return np.repeat(np.maximum(size, 1e-9), [grams, len(places) - grams])


def margin(places: np.ndarray, weights: np.ndarray, squares: np.ndarray, bias: float) -> float:
    return float((weights[places] / lengths(places, squares)).sum(dtype=np.float64)) + bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and constant of the sigmoid, by Newton steps; classes weigh as their shares."""
    t = (y == 1).astype(float)
    weight = np.where(y == 1, prior / t.mean(), (1 - prior) / (1 - t.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        s = weight * p * (1 - p) + 1e-9
        g = np.array([(weight * (p - t) * margins).sum() + 1e-3 * a, (weight * (p - t)).sum()])
        h = np.array([[(s * margins ** 2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float) -> tuple[bytes, bytes, float, float, float]:
    """(weights, squares, bias, slope, constant) from feature places and 0/1 labels."""
    y = np.where(labels == 1, 1, -1)
    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        train = np.flatnonzero(fold != k)
        if len(set(y[train])) < 2:
            train = np.arange(len(rows))
        m = _model([rows[i] for i in train], y[train])
        for i in np.flatnonzero(fold == k):
            margins[i] = margin(rows[i], *m)
    slope, constant = sigmoid_fit(margins, y, prior)
    weights, squares, bias = _model(rows, y)
    return weights.tobytes(), squares.tobytes(), bias, slope, constant


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels of the sample, and the number of usable labels of each class."""
    usable = (labels.where("doc_id is not null and quality in (0, 1)")
              .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
              .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = None
    for label in (0, 1):
        least = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        ids = least if ids is None else ids.union(least)
    texts = text_bytes(docs, "doc_id").join(F.broadcast(write_table(ids, "sample")), "doc_id")
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("m")     # of a hot id, one a task
    return texts.groupBy("doc_id", "label").agg(one).select("doc_id", "label", F.col("m._text").alias("_text")), counts


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The fitted model as plain values: arrays of ``PLACES`` floats and three numbers."""
    sample, counts = training_sample(docs, labels)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffers(batch.column("_text"))
        f = Features()
        found = [f.places(data[a:b]).tobytes() for a, b in zip(offs[:-1], offs[1:])]
        return pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "label": batch.column("label"),
                                "places": pa.array(found, pa.binary())})

    def fitted(batches):
        rows = sorted((r["doc_id"], r["label"], r["places"]) for b in batches for r in b.to_pylist())
        y = np.array([r[1] for r in rows])
        if len(set(y.tolist())) == 2:
            w, s, *numbers = fit([np.frombuffer(r[2], np.int32) for r in rows], y, prior)
        else:
            w = s = np.zeros(PLACES, np.float32).tobytes()
            share = min(max(prior, 1e-9), 1 - 1e-9)
            numbers = [0.0, 1.0, float(np.log(share / (1 - share)))]
        yield pa.record_batch([[w], [s], *[[x] for x in numbers]], names=["weights", "squares", "bias", "slope", "constant"])

    features = write_table(arrow_rows(sample, places, "doc_id long, label int, places binary"), "sample-features")
    # sizes of at most 2 * PER_CLASS rows, summed in the order of the sample
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = (features.select("doc_id", "label", F.sum(F.octet_length("places")).over(order).alias("bytes"))
              .where(F.col("bytes") <= CLASS_BYTES).select("doc_id"))
    features = features.join(within, "doc_id", "left_semi")
    row = (features.repartition(1).mapInArrow(fitted, "weights binary, squares binary, bias double, slope double, constant double")
           .first())
    if row is None:     # no partition, no batch: an untrained model
        return {"weights": np.zeros(PLACES, np.float32), "squares": np.zeros(PLACES, np.float32),
                "bias": 0.0, "slope": 1.0, "constant": 0.0}
    return row.asDict() | {k: np.frombuffer(bytes(row[k]), np.float32) for k in ("weights", "squares")}


def score_texts(docs: DataFrame, model: dict, *cols: str) -> DataFrame:
    """``cols`` of ``docs`` and ``score`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, f = shared.value, Features()
        for batch in batches:
            data, offs = buffers(batch.column("_text"))
            z = np.array([margin(f.places(data[a:b]), m["weights"], m["squares"], m["bias"])
                          for a, b in zip(offs[:-1], offs[1:])], float)
            score = 1 / (1 + np.exp(-np.clip(m["slope"] * z + m["constant"], -30, 30)))
            yield batch.drop_columns(["_text"]).append_column("score", pa.array(score))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema.fields)
    return text_bytes(docs, *cols).mapInArrow(run, f"{kept}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    scored = score_texts(docs, train(docs, labels), "doc_id")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows the classifier rejects; all columns as they are."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("text").alias("_plain"))
    scored = score_texts(plain.withColumnRenamed("_plain", "text"), train(docs, labels), *names.values())
    return scored.where(F.col("score") >= THRESHOLD).select(*[F.col(n).alias(c) for c, n in names.items()])
