r"""Fill-in-middle transformation over a boundary set (operator 11).

A text is a sequence of lines (``[^\n]*\n|[^\n]+``). The places where it may be cut, after 0 to
n lines, form a compressed set of byte offsets: values are grouped by their upper 16 bits into
containers, each held as whichever of three forms is the smallest for it: a sorted array, a
bitmap of 65,536 bits, or runs (start, length). Beside the containers stand their cumulative
cardinalities. ``select(k)`` searches these for the container that holds the k-th value and
selects within it: by index in an array, by counting bits in a bitmap, by cumulative lengths in
runs. Two selects give both cuts of a text, whatever its length.

Cuts, form and order follow from a digest of seed and ``doc_id``, so that reruns, retried tasks
and other partitionings agree. ``plain`` leaves a text as it is, ``psm`` writes prefix, suffix,
middle and ``spm`` suffix, prefix, middle, each behind its mark. Texts that hold a mark stay
plain, so that ``restore`` finds each mark at its first place and gives the exact text back.

Defined cases: a null text counts as empty; empty texts are plain with 0 lines; a null ``doc_id``
is digested as the empty string and returned as null; rows with one ``doc_id`` are cut by the
same digits, each in its own text; a prefix, middle or suffix may be empty; further columns are
ignored; an empty table gives no rows. A row's work and memory grow with its own text only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm.common import arrow_rows, buffers, text_bytes

SEED = 7
FIM_PERCENT, SPM_PERCENT = 100, 50
MARKS = ("<P>", "<S>", "<M>")

_LOW = 1 << 16
#: Bytes of a bitmap container; an array takes 2 a value, runs take 4 a run.
_BITMAP = _LOW // 8


class Container:
    """The values of one 2^16 range, as ``array``, ``bitmap`` or ``run``."""

    __slots__ = ("kind", "data", "extra")

    def __init__(self, low: np.ndarray):
        low = low.astype(np.int64)
        begin = np.flatnonzero(np.r_[True, np.diff(low) != 1])
        if 4 * len(begin) < min(2 * len(low), _BITMAP):
            lengths = np.diff(np.r_[begin, len(low)])
            self.kind, self.data, self.extra = "run", low[begin].astype(np.uint16), np.cumsum(lengths)
        elif 2 * len(low) <= _BITMAP:
            self.kind, self.data, self.extra = "array", low.astype(np.uint16), None
        else:
            bits = np.zeros(_LOW, bool)
            bits[low] = True
            self.kind, self.data = "bitmap", np.packbits(bits, bitorder="little").view(np.uint64)
            self.extra = np.cumsum(np.bitwise_count(self.data), dtype=np.int64)

    def select(self, k: int) -> int:
        """The k-th smallest value (from 0)."""
        if self.kind == "array":
            return int(self.data[k])
        at = int(np.searchsorted(self.extra, k, side="right"))
        k -= int(self.extra[at - 1]) if at else 0
        if self.kind == "run":
            return int(self.data[at]) + k
        word = np.unpackbits(self.data[at:at + 1].view(np.uint8), bitorder="little")
        return 64 * at + int(np.flatnonzero(word)[k])


class BoundarySet:
    """A set of non-negative integers, built from sorted distinct values, with ``select``."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        begin = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(values) else np.zeros(0, np.int64)
        self.keys = high[begin]
        self.ends = np.r_[begin[1:], len(values)] if len(values) else begin     # cumulative cardinalities
        self.containers = [Container(values[a:b] & (_LOW - 1)) for a, b in zip(begin, self.ends)]

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def select(self, k: int) -> int:
        """The k-th smallest value (from 0)."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.ends, k, side="right"))
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - (int(self.ends[at - 1]) if at else 0))


def line_boundaries(data: np.ndarray) -> BoundarySet:
    """The byte offsets after 0, 1, … n lines of a text."""
    ends = np.flatnonzero(data == 10) + 1
    rest = [len(data)] if len(data) and (not len(ends) or ends[-1] < len(data)) else []
    return BoundarySet(np.concatenate([[0], ends, rest]).astype(np.int64))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of the digest of ``seed:doc_id``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def check_marks(marks) -> None:
    """A mark's first character stands in no mark but at its start, and no mark begins another:
    then no mark can arise across the seam of a part and a mark."""
    first = {m[:1] for m in marks}
    if len(marks) != 3 or "" in first or any(c in m[1:] for c in first for m in marks) \
            or any(a is not b and b.startswith(a) for a in marks for b in marks):
        raise ValueError(f"marks can be confused: {marks}")


def transform(text: bytes, doc_id: int | None, seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT, marks=MARKS) -> tuple[int, str, bytes, int | None, int | None]:
    """(lines, form, output, code points of the prefix, of the middle) of one text."""
    data = np.frombuffer(text, np.uint8)
    cuts = line_boundaries(data)
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    p, s, m = (x.encode() for x in marks)
    if not text or any(x in text for x in (p, s, m)) or h3 % 100 >= fim_percent:
        return n, "plain", text, None, None
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts.select(lo), cuts.select(hi)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    sizes = code_points(data[:a]), code_points(data[a:b])
    if h4 % 100 < spm_percent:
        return n, "spm", b"".join((s, suffix, p, prefix, m, middle)), *sizes
    return n, "psm", b"".join((p, prefix, s, suffix, m, middle)), *sizes


def restore(output: bytes, form: str, marks=MARKS) -> bytes:
    """The text that ``transform`` wrote as ``output``."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in marks)
    first, second = (s, p) if form == "spm" else (p, s)
    i = output.index(second, len(first))
    j = output.index(m, i + len(second))
    one, two, middle = output[len(first):i], output[i + len(second):j], output[j + len(m):]
    return b"".join((two, middle, one) if form == "spm" else (one, middle, two))


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars) of each row of ``docs``."""
    check_marks(marks)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column("doc_id").cast(pa.int64()).to_pylist()
        rows = [transform(t, i, seed, fim_percent, spm_percent, marks) for t, i in zip(b.column("_text").to_pylist(), ids)]
        n, form, output, prefix, middle = zip(*rows)
        return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "form": pa.array(form),
                                "output": pa.array(output, pa.binary()), "prefix_chars": pa.array(prefix, pa.int64()),
                                "middle_chars": pa.array(middle, pa.int64())})

    found = arrow_rows(text_bytes(docs, "doc_id"), run,
                       "doc_id long, n long, form string, output binary, prefix_chars long, middle_chars long")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(cut: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of ``fill_in_middle`` with the column ``restored``: the text rebuilt from output and form."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [restore(o, f, marks) for o, f in zip(b.column("_text").to_pylist(), b.column("form").to_pylist())]
        return pa.record_batch([*(b.column(c) for c in keep), b.column("_text"), pa.array(texts, pa.binary())],
                               names=[*keep, "output", "restored"])

    keep = [c for c in cut.columns if c != "output"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "output")
    back = arrow_rows(text_bytes(cut, *keep, text="output"), run, f"{kinds}, output binary, restored binary")
    return back.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def fim_digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: lines, form, sizes, and digests of the output and of the text rebuilt from it."""
    done = restored(fill_in_middle(docs))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
