r"""Substring dedup by level-wise doubling (operator 9).

Words are ``[^\x20\x09-\x0D]+``, unchanged. A window is ``window`` (50) consecutive words of
one document; each word covered by a window whose word sequence also starts in a document
with a smaller ``doc_id`` is removed. Windows are judged on the input.

Method. A window repeats only if its half (25 words) does, so halves are counted first and
only those that occur in two documents are extended to twice their length:

1. *Half level.* Of the 26 halves inside a window the one with the least hash (leftmost of
   equals) stands for it: equal windows choose the same half at the same place, so about one
   half in 13 words is shuffled instead of each, and none is missed. A row also holds the run
   of windows that chose this half and a hash of all words which that run covers.
2. Halves that occur in two documents survive. Survivors whose whole run equals the run in a
   document with a smaller id are settled: thousands of copies cost one grouped minimum, and
   one row a document meets the list of runs that it is the first to hold.
3. *Full level.* Of halves with several different runs, one document a run (the smallest id)
   is extended: each of its windows is hashed whole (128 bits) and compared by grouped
   minimum. Longer levels cannot change which words are covered, so doubling ends there,
   or earlier, when no candidate survives.

No step gathers the rows of a hash: minima are combined before the shuffle, and join
partitions of a hot hash are split by AQE (for which both sides of such a join come straight
from a table: the grouped side is written first).

Defined cases: null and blank texts have no words (``kept_sha256`` of the empty text); rows
with the same ``doc_id`` don't remove each other's words, and each is judged by itself; rows
with a null ``doc_id`` keep all words and remove none; texts under 50 words keep all; an
empty table gives no rows; further columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm import words as W
from histshift.llm.common import arrow_rows, buffers, int64_of, slices, text_bytes, write_table

WINDOW = 50
_ODD = np.uint64(0x9E3779B97F4A7C15)
_JUDGED = ("doc_id long, text_hash long, settled array<struct<first:int,stop:int>>, "
           "runs array<struct<first:int,last:int>>")
_ANCHORS = "half long, run long, doc_id long, text_hash long, at int, first int, last int"


def _text_hash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of each text's words, to tell rows with one doc_id apart."""
    place = W.mix(np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(W.mix(h ^ place), out=sums[1:])
    return W.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, half hash, run hash, place of the half, first and last window that chose it).

    ``h``: word hashes of several texts, ``first``: index of each text's first word. Places
    count words from the start of the text.
    """
    half = window // 2
    span = window - half + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(h) < window:
        return none
    grams = W.ngrams(h, half)
    starts = np.arange(len(h) - window + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = text[starts] == text[starts + window - 1]
    starts = starts[ok]
    if not len(starts):
        return none
    chosen = starts + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)[ok]
    begin = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[starts[1:]] != text[starts[:-1]])])
    s1, s2, at = starts[begin], starts[np.r_[begin[1:], len(starts)] - 1], chosen[begin]
    powers = np.multiply.accumulate(np.full(2 * window, _ODD, np.uint64))
    length = s2 + window - s1
    run = np.zeros(len(begin), np.uint64)
    for k in range(int(length.max())):      # at most 2 * window steps, each over all runs
        live = length > k
        run[live] += h[s1[live] + k] * powers[k]
    run = W.pair(W.mix(run), ((at - s1) * 4096 + length).astype(np.uint64))
    base = first[text[s1]]
    return text[s1], grams[at].view(np.int64), run.view(np.int64), at - base, s1 - base, s2 - base


def _halves(window: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffers(batch.column("_text"))
        ids = int64_of(batch.column("doc_id"))
        parts = []
        for i, j in slices(offs):
            d, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            starts, ends, first = W.bounds(d, o)
            h = W.hashes(d, starts, ends)
            t, *rest = anchors(h, first, window)
            parts.append((rest[0], rest[1], ids[i:j][t], _text_hash(h, first)[t], *rest[2:]))
        cols = [np.concatenate(x) for x in zip(*parts)]
        return pa.record_batch([pa.array(c.astype(np.int64 if k < 4 else np.int32)) for k, c in enumerate(cols)],
                               names=["half", "run", "doc_id", "text_hash", "at", "first", "last"])
    return run


def _judge(window: int):
    """Of each text's surviving halves: word ranges settled by their run alone (an earlier
    document has the same run), and the runs this document has to be extended for."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchors, own = batch.column("anchors"), batch.column("own")
        row = np.repeat(np.arange(batch.num_rows), anchors.value_lengths().to_numpy(zero_copy_only=False))
        a, o = anchors.flatten(), own.flatten()
        mine = np.repeat(np.arange(batch.num_rows), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        keys = zip(mine.tolist(), o.field("half").to_pylist(), o.field("run").to_pylist())
        least_here = dict(zip(keys, o.field("open").to_pylist()))
        settled: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for r, half, whole, lo, hi in zip(row.tolist(), *(a.field(f).to_pylist() for f in ("half", "run", "first", "last"))):
            opened = least_here.get((r, half, whole))
            if opened is None:
                settled[r].append({"first": lo, "stop": hi + window})
            elif opened:
                runs[r].append({"first": lo, "last": hi})

        def spans(x, b):
            return pa.array(x, pa.list_(pa.struct([("first", pa.int32()), (b, pa.int32())])))
        return pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), spans(settled, "stop"), spans(runs, "last")],
                               names=["doc_id", "text_hash", "settled", "runs"])
    return run


def _windows(window: int):
    """Whole hashes of the windows in the listed runs of each text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffers(batch.column("_text"))
        ids, marks = int64_of(batch.column("doc_id")), int64_of(batch.column("text_hash"))
        out = []
        for i in range(batch.num_rows):
            d, o = data[offs[i]:offs[i + 1]], offs[i:i + 2] - offs[i]
            starts, ends, first = W.bounds(d, o)
            h = W.hashes(d, starts, ends)
            if int(_text_hash(h, first)[0]) != marks[i]:
                continue        # another row with the same doc_id
            a, b = W.ngrams(h, window), W.ngrams(W.mix(h + _ODD), window)
            runs = np.array([(r["first"], r["last"]) for r in batch.column("runs")[i].as_py()])
            s = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in runs]))
            out.append((a[s].view(np.int64), b[s].view(np.int64), np.full(len(s), ids[i]), np.full(len(s), marks[i]), s))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.record_batch([pa.array(c.astype(np.int64 if k < 4 else np.int32)) for k, c in enumerate(cols)],
                               names=["win_a", "win_b", "doc_id", "text_hash", "first"])
    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, ranges): word ranges [start, stop) to remove, one row per text."""
    docs = docs.where("doc_id is not null")
    halves = write_table(arrow_rows(text_bytes(docs, "doc_id"), _halves(window), _ANCHORS), "halves")
    repeated = write_table(halves.groupBy("half").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                           .where("lo < hi").select("half"), "repeated")
    alive = write_table(halves.join(repeated, "half"), "survivors")
    runs = write_table(alive.groupBy("half", "run").agg(F.min("doc_id").alias("least")), "runs")
    several = write_table(runs.groupBy("half").agg(F.count("*").alias("n_runs")).where("n_runs > 1")
                          .select("half", F.lit(True).alias("open")), "several")
    own = write_table(runs.join(several, "half", "left").groupBy(F.col("least").alias("doc_id"))
                      .agg(F.collect_list(F.struct("half", "run", F.coalesce("open", F.lit(False)).alias("open"))).alias("own")), "own")
    per_text = alive.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("half", "run", "first", "last")).alias("anchors"))
    judged = write_table(arrow_rows(per_text.join(own, "doc_id", "left"), _judge(window), _JUDGED), "judged")

    open_ = judged.where(F.size("runs") > 0).select("doc_id", "text_hash", "runs")
    wins = write_table(arrow_rows(text_bytes(docs, "doc_id").join(open_, "doc_id"), _windows(window),
                                  "win_a long, win_b long, doc_id long, text_hash long, first int").distinct(), "windows")
    least = write_table(wins.groupBy("win_a", "win_b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("hi"))
                        .where("least < hi").drop("hi"), "least")
    extended = (wins.join(least, ["win_a", "win_b"]).where("doc_id > least").groupBy("doc_id", "text_hash")
                .agg(F.collect_set(F.struct("first", (F.col("first") + window).alias("stop"))).alias("ranges")))
    settled = judged.where(F.size("settled") > 0).select("doc_id", "text_hash", F.col("settled").alias("ranges"))
    return (settled.union(extended).groupBy("doc_id", "text_hash")
            .agg(F.flatten(F.collect_list("ranges")).alias("ranges")))


def kept_mask(n: int, ranges: list[dict]) -> np.ndarray:
    """True for the words outside all ranges."""
    step = np.zeros(n + 1, np.int32)
    for r in ranges:
        step[r["first"]] += 1
        step[r["stop"]] -= 1
    return np.cumsum(step[:-1]) == 0


def _ranged(docs: DataFrame, window: int, *cols: str) -> DataFrame:
    """The texts with all range lists of their doc_id (several only where ids repeat)."""
    ranges = write_table(repeated_ranges(docs, window).groupBy("doc_id")
                         .agg(F.collect_list(F.struct("text_hash", "ranges")).alias("lists")), "ranges")
    return text_bytes(docs, "doc_id", *cols).join(ranges, "doc_id", "left")


def _kept(text: bytes, lists: list[dict] | None) -> tuple[list[bytes], np.ndarray]:
    found = text.split()        # splits bytes at exactly \x20 and \x09-\x0D
    if not lists:
        return found, np.ones(len(found), bool)
    d, o = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, first = W.bounds(d, o)
    mark = int(_text_hash(W.hashes(d, starts, ends), first)[0])
    return found, kept_mask(len(found), [r for x in lists if x["text_hash"] == mark for r in x["ranges"]])


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, sha = [], [], []
        for text, lists in zip(batch.column("_text"), batch.column("lists")):
            found, keep = _kept(text.as_py(), lists.as_py())
            n.append(len(found))
            removed.append(int(len(found) - keep.sum()))
            kept = found if keep.all() else [w for w, k in zip(found, keep) if k]
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": pa.array(n, pa.int64()),
                                "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})
    return arrow_rows(_ranged(docs, window), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (all other columns as they are).

    Texts that lose nothing stay byte for byte; of the others the stretches between removed
    words stay as written, joined by one space. ``n_chars``, where present, is counted anew.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, lists in zip(batch.column("_text"), batch.column("lists")):
            t, lists = text.as_py(), lists.as_py()
            keep = _kept(t, lists)[1] if lists else np.ones(0, bool)
            if not keep.all():
                d = np.frombuffer(t, np.uint8)
                starts, ends, _ = W.bounds(d, np.array([0, len(t)]))
                edge = np.flatnonzero(np.diff(np.r_[0, keep.astype(np.int8), 0]))
                t = b" ".join(t[starts[a]:ends[b - 1]] for a, b in zip(edge[::2], edge[1::2]))
            out.append(t)
        i = batch.schema.get_field_index("_text")
        return batch.set_column(i, "_text", pa.array(out, pa.binary())).drop_columns(["lists"])

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)])
    ranged = _ranged(plain, window, *[f"c{k}" for k in range(len(others))], F.col("text").isNull().alias("_null"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields if f.name != "lists")
    done = arrow_rows(ranged, run, schema)
    text = F.when(~F.col("_null"), F.col("_text").cast("string"))
    cut = {c: F.col(f"c{k}").alias(c) for k, c in enumerate(others)}
    if "n_chars" in cut:
        cut["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*[text.alias("text") if c == "text" else F.col("doc_id") if c == "doc_id" else cut[c]
                         for c in docs.columns])
