r"""Mixing sources to target weights (operator 12).

The sources of a table share a total of words by weight; none gives more than ``epochs`` times
what it holds, and what it cannot give is shared again among the others by their weights.

Each document gets a hash-random key; rows are range-sorted by (source, key), and distributed
prefix sums of their sizes say how many words of the source stand before each of them. A source's
budget is its target, rounded down to whole words: as many whole epochs of the source as fit, then
one more epoch cut at the exact word, so that the words taken add up to the budget. A document at
the cut gives its first words only. Keys follow from seed and ``doc_id`` and the order is total,
so reruns agree, whatever the partitioning.

The texts never take part in the sort: ``plan_mix`` works on sizes, and ``mixed_texts`` emits the
texts by a join with the plan.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a
null ``doc_id`` is keyed as the empty string; rows with one ``doc_id`` are rows of their own
(in the order of a hash of their texts; equal rows are interchangeable); a source without words
has target 0; an empty table gives no rows; further columns are ignored. Sizes are counted over
all rows; nothing but a few totals per round of sharing reaches the driver.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm import words as W
from histshift.llm.common import arrow_rows, buffers, slices, text_bytes, write_table
from histshift.llm.prefix import prefix_sums

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
EPOCHS = 2
SEED = 12
#: A source as two columns that sort and join without nulls: known sources first, by code point.
_SOURCE = ["no_source", "source_name"]


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, no_source, source_name, size, key, text_hash), one row per row of ``docs``."""
    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffers(b.column("_text"))
        n = np.zeros(b.num_rows, np.int64)
        for i, j in slices(offs):
            n[i:j] = np.diff(W.bounds(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])[2])
        keep = [b.column(c) for c in ("doc_id", *_SOURCE, "key", "text_hash")]
        return pa.record_batch([*keep, pa.array(n)], names=["doc_id", *_SOURCE, "key", "text_hash", "size"])

    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_)), 1, 15), 16, 10).cast("long")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_name"),
                        key.alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    return arrow_rows(text_bytes(keyed, "doc_id", *_SOURCE, "key", "text_hash"), count,
                      "doc_id long, no_source boolean, source_name string, key long, text_hash long, size long")


def shared_targets(sources: DataFrame, total: Fraction, epochs: int) -> DataFrame:
    """``sources`` (with weight, source_size) and the column ``target_num``/``target_den``, an exact fraction.

    A round gives every source that is not full its share of what is left; sources whose share
    exceeds ``epochs`` times their size are full from then on. The share by weight only grows,
    so the rounds end, and each is one aggregate over the sources.
    """
    cap = (F.col("source_size") * epochs).cast("decimal(38,0)")
    level = Fraction(0)
    while True:
        full = cap * F.lit(level.denominator).cast("decimal(20,0)") <= F.col("weight") * F.lit(level.numerator).cast("decimal(20,0)")
        r = sources.agg(F.sum(F.when(full, cap)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        before, level = level, (total - int(r["given"] or 0)) / int(r["open"])
        if level == before:
            break
    over = cap * F.lit(level.denominator).cast("decimal(20,0)") <= F.col("weight") * F.lit(level.numerator).cast("decimal(20,0)")
    return sources.select("*", F.when(over, F.col("source_size") * epochs)
                          .otherwise(F.col("weight") * F.lit(level.numerator)).alias("target_num"),
                          F.when(over, F.lit(1)).otherwise(F.lit(level.denominator)).cast("long").alias("target_den"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, text_hash.

    ``weights`` go to the sources in their order, repeating. ``taken``: words the mix takes of the
    row, repeats counted.
    """
    rows = write_table(sizes(docs, seed), "sizes")
    stats = rows.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one"))
    placed = (prefix_sums(stats.withColumn("all", F.lit(0)), ["all"], _SOURCE, "one", "place", "sources")
              .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]),
                                                 (F.col("place") % len(weights) + 1).cast("int"))))
    sources = write_table(placed.select(*_SOURCE, "source_size", "weight"), "weights")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = shared_targets(sources, words * share, epochs)
    budget = F.expr("target_num div target_den")
    targets = write_table(targets.select(
        F.col("no_source").alias("_n"), F.col("source_name").alias("_s"), "source_size",
        (F.col("target_num").cast("double") / F.col("target_den")).alias("target"),
        F.when(F.col("source_size") > 0, F.expr("(target_num div target_den) div source_size")).otherwise(0).alias("whole"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).alias("rest")), "targets")
    placed = prefix_sums(rows, _SOURCE, ["key", "doc_id", "text_hash"], "size", "before", "mix")
    taken = F.col("whole") * F.col("size") + F.least("size", F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("before")))
    return (placed.join(targets, (F.col("no_source") == F.col("_n")) & (F.col("source_name") == F.col("_s")))
            .select("doc_id", F.when(~F.col("no_source"), F.col("source_name")).alias("source"), "size", "source_size",
                    "target", taken.cast("long").alias("taken"), "text_hash"))


def mixed_texts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: (doc_id, source, text, epoch), epochs from 0; a document at a source's cut
    ends after its last taken word, the others are whole. Equal rows are added up first."""
    keys = ["_id", "_source", "_hash"]
    some = (plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"))
            .agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size")).where("_taken > 0"))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                         "text", F.xxhash64("text").alias("text_hash")).dropDuplicates(["doc_id", "source", "text_hash"]))
    some = write_table(some, "taken")
    same = F.lit(True)
    for a, b in zip(("doc_id", "source", "text_hash"), keys):
        same &= F.col(a).eqNullSafe(F.col(b))
    times = F.ceil(F.col("_taken") / F.col("_size")).cast("long")
    epoch = texts.join(some, same).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    left = F.least("_size", F.col("_taken") - F.col("epoch") * F.col("_size")).cast("long")
    cut = epoch.select("doc_id", "source", "epoch", F.when(left < F.col("_size"), left).alias("left"), "text")

    def first_words(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, n in zip(b.column("_text").to_pylist(), b.column("left").to_pylist()):
            if n is not None:
                data = np.frombuffer(text, np.uint8)
                text = text[:int(W.bounds(data, np.array([0, len(data)]))[1][n - 1])]
            out.append(text)
        return pa.record_batch([b.column(c) for c in ("doc_id", "source", "epoch")] + [pa.array(out, pa.binary())],
                               names=["doc_id", "source", "epoch", "text"])

    done = arrow_rows(text_bytes(cut, "doc_id", "source", "epoch", "left"), first_words,
                      "doc_id long, source string, epoch long, text binary")
    return done.select("doc_id", "source", F.col("text").cast("string").alias("text"), "epoch")


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``."""
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")
