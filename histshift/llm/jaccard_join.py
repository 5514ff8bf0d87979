r"""N-gram Jaccard join by parity sketches (operator 10).

A document's set holds its distinct 5-word shingles (words ``[^\x20\x09-\x0D]+``, A-Z lower
cased; fewer words: the whole sequence; none: empty). Two documents link when
100 * intersection >= 80 * union.

Method. Sets of a and b shingles that link differ in at most ``(a + b) // 9`` shingles.
Shingles are dealt by hash over ``p`` parts and XOR-hashed within each part, so that a part
of two sketches differs only where the sets differ: at most ``(a + b) // 9`` parts do, and
the others agree (pigeonhole). Size bands [2^j, 2.5 * 2^j) overlap so that any two sets that
can link share a band, hence ``p``. Parts are ranked by (shingles in them, XOR), a rank that
depends on their content alone: of all parts two sets agree in, the first in rank is among
the first ``d + 1`` of either (``d``: the most parts that any partner can change), so that
joining only these loses nothing, and parts holding one shingle, or none, hardly take part.

Equal parts make a group. Verification never expands a group into all its pairs: each set is
first tried against the smallest id it met; linked sets form components; only groups that
still hold more than one component are looked at again, and then only pairs across
components. Candidates pass a one-bit parity sketch, whose Hamming distance is a lower bound
of the symmetric difference, then an exact comparison of the shingle sets. Equal sets
collapse to one representative before any of this.

Defined cases: null or blank texts have an empty set, link with nothing and are their own
component; rows with the same ``doc_id`` are one node; rows with a null ``doc_id`` link with
nothing and have a null component; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm import words as W
from histshift.llm.common import arrow_rows, buffers, int64_of, slices, text_bytes, write_table
from histshift.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Parts per shingle at the lower end of a size band.
PARTS = 0.8
#: Groups of more members than this are compared in blocks of about BLOCK members.
SMALL_GROUP, BLOCK = 16, 512
#: A task remembers so many sets it has emitted already (a saving only).
SEEN = 200_000

_SETS = "doc_id long, n_shingles long, set_a long, set_b long, sketch binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (empty: no words)."""
    starts, ends, first = W.bounds(data, offsets)
    h = W.hashes(data, starts, ends, lower=True)
    grams = W.ngrams(h, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            g = np.sort(grams[a:b - k + 1])
            out.append(g[np.r_[True, g[1:] != g[:-1]]])
        elif b > a:
            out.append(W.mix(W.ngrams(h[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def most_changes(a, b):
    """Largest symmetric difference of two linked sets of a and b shingles."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def parity_sketch(u: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each of 2^k >= max(64, n) bits."""
    m = max(64, 1 << int(len(u) - 1).bit_length()) if len(u) else 64
    at = (u >> np.uint64(7)) & np.uint64(m - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=m).astype(np.uint8) & 1,
                       bitorder="little").tobytes()


def hamming(x: bytes, y: bytes) -> int:
    """Distance of two parity sketches; the longer is folded by XOR to the shorter's length."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _bands(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, band, most changed parts) for the own band and for the one below, where shared."""
    j = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    low = np.int64(1) << j
    own = most_changes(n, np.minimum(5 * n // 4, 5 * low // 2))
    below = np.where(n < 5 * low // 4 + (low % 4 > 0), most_changes(n, low - 1), 0)
    return [(np.flatnonzero(d > 0), j - k, d) for k, d in ((0, own), (1, below))]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) of the parts that each set enters into the join."""
    n = np.array([len(s) for s in sets], np.int64)
    whose, keys = [], []
    for rows, band, d in _bands(n):
        if not len(rows):
            continue
        u = np.concatenate([sets[i] for i in rows])
        at = np.repeat(rows, n[rows])
        p = np.maximum(np.ceil(PARTS * (1 << band)).astype(np.int64), 2)
        part = ((W.mix(u + band[at].astype(np.uint64)) >> np.uint64(32)) * p[at].astype(np.uint64)) >> np.uint64(32)
        where = (at << 32) | part.astype(np.int64)
        order = np.argsort(where, kind="stable")
        where = where[order]
        begin = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        xor = np.bitwise_xor.reduceat(W.mix(u[order]), begin)
        count = np.diff(np.r_[begin, len(where)])
        doc, idx = where[begin] >> 32, where[begin] & 0xFFFFFFFF
        key = W.pair(W.pair(xor, idx.astype(np.uint64)), (band[doc] * 1024 + 1).astype(np.uint64) + (count.astype(np.uint64) << np.uint64(20)))
        rank = np.lexsort((key, -count, doc))
        begin = np.searchsorted(doc, rows)
        nth = np.arange(len(doc)) - np.repeat(begin, np.diff(np.r_[begin, len(doc)]))
        kept = rank[nth <= d[doc]]     # doc is sorted, so rank permutes within documents only
        whose.append(doc[kept])
        keys.append(key[kept])
        filled = np.diff(np.r_[begin, len(doc)])
        for i, full in zip(rows[filled <= d[rows]], filled[filled <= d[rows]]):
            # fewer filled parts than it has to enter: empty parts come next, by their index
            used = set(idx[doc == i].tolist())
            empty = [x for x in range(int(p[i])) if x not in used][:int(d[i] + 1 - full)]
            whose.append(np.full(len(empty), i, np.int64))
            keys.append(W.pair(np.array(empty, np.uint64), np.full(len(empty), int(band[i]) * 1024, np.uint64)))
    if not whose:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(whose), np.concatenate(keys)


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = buffers(batch.column("_text"))
    n, a, b, sketch = [], [], [], []
    for i, j in slices(offs):
        for u in shingle_sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]):
            n.append(len(u))
            a.append(int(W.mix(u).sum(dtype=np.uint64).view(np.int64)) if len(u) else 0)
            b.append(int(W.mix(u + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) if len(u) else 0)
            sketch.append(parity_sketch(u))
    return pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(n, pa.int64()),
                            "set_a": pa.array(a, pa.int64()), "set_b": pa.array(b, pa.int64()),
                            "sketch": pa.array(sketch, pa.binary())})


def _emit(batches):
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = buffers(batch.column("_text"))
        ids = int64_of(batch.column("doc_id"))
        for i, j in slices(offs):
            sets = shingle_sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            for k, u in enumerate(sets):
                if len(u):
                    mark = (len(u), int(W.mix(u).sum(dtype=np.uint64)), int(u[0]))
                    if mark in seen:
                        sets[k] = u[:0]
                    elif len(seen) < SEEN:
                        seen.add(mark)
            whose, keys = signatures(sets)
            yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "doc": pa.array(ids[i:j][whose])})


def describe(docs: DataFrame) -> DataFrame:
    """One row per document: size and 128-bit hash of its set, and its parity sketch."""
    return arrow_rows(text_bytes(docs, "doc_id"), _describe, _SETS)


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sizes and parity sketches allow a link."""
    side = {x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
            for x in "ab"}
    both = (pairs.join(side["a"], "a").join(side["b"], "b")
            .where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"))

    def near(b: pa.RecordBatch) -> pa.RecordBatch:
        most = most_changes(int64_of(b.column("na")), int64_of(b.column("nb")))
        keep = [hamming(x, y) <= d for x, y, d in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), most)]
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_rows(both.select("a", "b", "na", "nb", "sa", "sb"), near, "a long, b long").distinct()


def _linked(b: pa.RecordBatch) -> pa.RecordBatch:
    keep = np.zeros(b.num_rows, bool)
    (xa, oa), (xb, ob) = buffers(b.column("ta")), buffers(b.column("tb"))
    for i in range(b.num_rows):
        x, = shingle_sets(xa[oa[i]:oa[i + 1]], oa[i:i + 2] - oa[i])
        y, = shingle_sets(xb[ob[i]:ob[i + 1]], ob[i:i + 2] - ob[i])
        shared = len(x) + len(y) - len(np.union1d(x, y))
        keep[i] = len(x) > 0 and 100 * shared >= PERCENT * (len(x) + len(y) - shared)
    return b.select(["a", "b"]).filter(pa.array(keep))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): sketches first, then the whole sets, exactly."""
    close = write_table(_close(pairs, sets), f"{name}-close")
    ids = close.select(F.col("a").alias("doc_id")).union(close.select(F.col("b").alias("doc_id"))).distinct()
    texts = write_table(text_bytes(docs, "doc_id").join(ids, "doc_id", "left_semi"), f"{name}-texts")
    side = {x: texts.select(F.col("doc_id").alias(x), F.col("_text").alias(f"t{x}")) for x in "ab"}
    both = close.join(side["a"], "a").join(side["b"], "b").select("a", "b", "ta", "tb")
    return write_table(arrow_rows(both, _linked, "a long, b long").distinct(), f"{name}-links")


def _across(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs of different components within groups (key, doc, component, members)."""
    small = groups.where(F.col("members") <= SMALL_GROUP).select("key", "doc", "component")
    x, y = small.alias("x"), small.alias("y")
    pairs = (x.join(y, "key").where("x.doc < y.doc and x.component <> y.component")
             .select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct())
    large = (groups.where(F.col("members") > SMALL_GROUP)
             .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
             .join(sets.select(F.col("doc_id").alias("doc"), "n_shingles", "sketch"), "doc")
             .select("key", "i", "j", "own", "doc", "component", F.col("n_shingles").alias("n"), "sketch"))

    def block(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own = t.column("own").to_numpy()
        doc, comp, n = (t.column(c).to_numpy() for c in ("doc", "component", "n"))
        width = min(len(s.as_py()) for s in t.column("sketch")) // 8
        bits = np.zeros((len(doc), width), np.uint64)
        for r, s in enumerate(t.column("sketch")):
            v = np.frombuffer(s.as_py(), np.uint64)
            bits[r] = np.bitwise_xor.reduce(v.reshape(-1, width), axis=0)
        a, b = [], []
        right = np.flatnonzero(own == j)
        for r in np.flatnonzero(own == i):
            near = np.bitwise_count(bits[right] ^ bits[r]).sum(axis=1, dtype=np.int64) <= most_changes(n[right], n[r])
            near &= (comp[right] != comp[r]) & (100 * np.minimum(n[right], n[r]) >= PERCENT * np.maximum(n[right], n[r]))
            for q in right[near]:
                a.append(min(doc[r], doc[q]))
                b.append(max(doc[r], doc[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.union(large.groupBy("key", "i", "j").applyInArrow(block, "a long, b long")).distinct()


def _shared(parts: DataFrame) -> DataFrame:
    """(key, doc, lo) of the written rows (key, doc) whose key several sets hold; lo: the least of them.

    Keys are combined before their shuffle and written, so that both sides of the join are plain
    shuffles, in which AQE splits a key that a third of all sets hold.
    """
    keys = parts.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key", "lo")
    return parts.join(write_table(keys, "keys"), "key")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text)."""
    sets = write_table(describe(docs), "sets")
    known = sets.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = write_table(known.select("doc_id", "set_a", "set_b", "n_shingles").distinct()
                       .join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "rep").distinct(), "reps")
    named = write_table(sets.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "named")

    parts = text_bytes(docs.where("doc_id is not null"), "doc_id").mapInArrow(_emit, "key long, doc long")
    met = _shared(write_table(parts, "parts"))
    met = met.join(reps.withColumnRenamed("doc_id", "doc"), "doc").select("key", F.col("rep").alias("doc")).distinct()
    met = write_table(_shared(write_table(met, "met")), "met")

    first = met.where("doc <> lo").groupBy("doc").agg(F.min("lo").alias("a")).select("a", F.col("doc").alias("b"))
    links = verified(first, named, docs, "first")
    part = components(links).withColumnsRenamed({"id": "doc", "component_id": "component"})
    labelled = (met.select("key", "doc").join(part, "doc", "left")
                .withColumn("component", F.coalesce("component", "doc")))
    mixed = (labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                         F.count("*").alias("members")).where("lo < hi").select("key", "members"))
    groups = write_table(labelled.join(mixed, "key"), "mixed")
    rest = _across(groups, named).join(first, ["a", "b"], "left_anti")
    links = links.union(verified(rest, named, docs, "rest"))

    links = links.union(reps.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    whole = write_table(components(links), "components").withColumnRenamed("id", "doc_id")
    return (sets.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id")))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the near duplicates: of each group of linked texts that with the smallest
    ``doc_id`` stays.

    Each row is judged by its own text: where rows share a ``doc_id``, one goes only if its own set
    is linked to another that stays. Rows equal in all columns count once; rows with a null
    ``doc_id``, and rows without words, are copies of nothing and stay.
    """
    known = docs.where("doc_id is not null")
    counts = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = write_table(counts, "repeated-ids")
    if repeated.isEmpty():
        gone = (jaccard_components(docs.select("doc_id", "text")).where("doc_id <> component_id")
                .select("doc_id").distinct())
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows of repeated ids become nodes of their own, numbered outside the range of all ids
    node = "_" * (1 + max(map(len, docs.columns)))       # a name that no column has
    span = known.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    many = known.join(repeated, "doc_id", "left_semi").dropDuplicates()
    many = write_table(many.withColumn(node, F.monotonically_increasing_id()), "repeated-rows")
    most = many.agg(F.max(node)).first()[0]
    up = span[1] + 1 + most < 1 << 63
    many = many.withColumn(node, F.lit(span[1] + 1) + F.col(node) if up else F.lit(span[0] - 1) - F.col(node))
    once = known.join(repeated, "doc_id", "left_anti")
    nodes = once.select(F.col("doc_id").cast("long").alias("doc_id"), "text").union(many.select(node, "text"))
    part = jaccard_components(nodes).select(F.col("doc_id").alias(node), "component_id")
    names = many.select(node, F.col("doc_id").cast("long").alias("own"))
    part = write_table(part.join(names, node, "left").withColumn("own", F.coalesce("own", node)), "judged")
    first = part.groupBy("component_id").agg(F.min(F.struct("own", node)).alias("m"))
    gone = write_table(part.join(write_table(first, "first"), "component_id").where(F.col(node) != F.col(f"m.{node}")).select(node), "gone")
    left = once.join(gone.withColumnRenamed(node, "doc_id"), "doc_id", "left_anti")
    kept = many.join(gone, node, "left_anti").drop(node)
    return left.unionByName(kept).unionByName(docs.where("doc_id is null")).select(docs.columns)
