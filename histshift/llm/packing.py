"""Best-fit packing by bin completion (operator 2).

Documents become token ids (plus an end id), longer ones are cut into pieces of
``capacity`` ids, and pieces are packed into as few sequences as can be found.

Method. Pieces are dealt by hash into shards of about ``SHARD`` pieces, whatever their
document, so that one long document or a table of any size spreads evenly; a piece that
fills a sequence needs no search. Each shard is packed by best-fit decreasing, whose result
is the incumbent. If it is above the lower bound, bin completion takes over. Its first branch,
the fullest filling beside the largest piece left, sequence after sequence, is followed to its
end over the whole shard (``first_branch``, with ``BRANCHES`` ways to choose between fillings
equally full) and becomes the incumbent where it is better. Then
the search looks for a packing with one sequence less: it takes the largest piece left,
enumerates the undominated fillings beside it, fullest first, and gives up a branch once the
waste so far exceeds what the better packing may waste in all. It runs over sets of
``SEARCH_BINS`` sequences: all sequences, in the order of their waste, are gone through set by set,
each wasteful set beside a share of the fuller ones, and again after each gain, until the bound
is met or no set of a whole round gives a gain. ``NODES`` and ``FILLINGS`` bound the search of one
set, ``ROUNDS`` the rounds. Each shard can end with one partly filled sequence.

Defined cases: null and empty texts are the end id alone; rows with equal or null ``doc_id``
are packed each by itself; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm.common import text_bytes, write_table

CAPACITY = 2048
SHARD = 16_384
SEARCH_BINS = 16
NODES = 2_000
FILLINGS = 64
ROUNDS = 12
BRANCHES = 4
VOCABULARY = "word_bpe_49k.json"
#: Words kept with their ids per worker, and the longest word kept (a saving only).
CACHE, CACHED_BYTES = 500_000, 64

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is one of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


#: The byte-level alphabet: bytes that print stand for themselves, others for U+0100 and up.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}


@cache
def encoder_of(vocabulary: str) -> "WordEncoder":
    """One encoder for the life of a Python worker, with the words it has met."""
    return WordEncoder(vocabulary)


class WordEncoder:
    """Token ids of whole texts from the ids of their words.

    The tokenizer drops white space and never merges across it, so a text's ids are its
    words' ids in a row. Words are encoded once while the cache holds them; words in ASCII and
    Latin-1 letters are looked up by their letter runs, digits and signs, as the tokenizer
    splits them. Added tokens such as ``<|endoftext|>`` inside a word keep their own ids.
    """

    # printable ASCII and the letters U+00C0 to U+00FF, in UTF-8
    PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
    SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x80-\xbf])+|[0-9]|[!-/:-`{-~]+").findall

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: bytes) -> bytes:
        """Ids of a lower-case letter run, a digit or a run of signs: nothing is left for the
        normaliser and the splitter, so the merges alone are run."""
        spelt = part.decode("latin-1").translate(_ALPHABET)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelt)])

    def learn(self, missing: list[bytes]) -> None:
        if len(self.parts) > CACHE:
            self.parts.clear()
        words, parts, split, others = self.words, self.parts, self.SPLIT, []
        for w in missing:
            if len(w) > CACHED_BYTES or not self.PLAIN(w) or b"<|" in w:
                others.append(w)
                continue
            found = split(w.lower() if w.isascii() else w.decode().lower().encode())
            for p in found:
                if p not in parts:
                    parts[p] = self._part(p)
            words[w] = parts[found[0]] if len(found) == 1 else b"".join([parts[p] for p in found])
        words.update(zip(others, self._encode([w.decode() for w in others])))

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text in UTF-8."""
        words = text.split()
        missing = set(words).difference(self.words)
        if missing:
            if len(self.words) > CACHE:
                self.words.clear()
                missing = set(words)
            self.learn(list(missing))
        out = b"".join(map(self.words.__getitem__, words))
        for w in missing:
            if len(w) > CACHED_BYTES:
                del self.words[w]
        return out


def tokenise(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = 0,
             keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, ids
    (little-endian unsigned 32-bit; null unless ``keep_ids``)."""
    def run(batches):
        encoder = encoder_of(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text")):
                ids = encoder.ids(text.as_py()) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k:k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return text_bytes(docs, "doc_id").mapInArrow(run, _PIECES)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Martello and Toth's bound L2: large pieces alone, and what the middle ones still need."""
    lengths = sorted(lengths, reverse=True)
    sums = np.r_[0, np.cumsum(lengths)]
    a = np.array(lengths)
    best = -(-int(sums[-1]) // capacity)
    for k in {0, *(x for x in lengths if 2 * x <= capacity)}:
        big, half, small = (int((a > capacity - k).sum()), int((2 * a > capacity).sum()), int((a >= k).sum()))
        rest = int(sums[small] - sums[half]) - ((half - big) * capacity - int(sums[half] - sums[big]))
        best = max(best, half + max(0, -(-rest // capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: sequences of indices; a bit set finds the tightest room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, out = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = mask >> lengths[i]
        if fits:
            room = lengths[i] + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(out), capacity
            out.append([])
        out[b].append(i)
        room -= lengths[i]
        rooms[room].append(b)
        mask |= 1 << room
    return out


def fillings(rest: list[int], room: int, limit: int = FILLINGS) -> list[list[int]]:
    """Undominated ways to fill ``room`` from ``rest`` (sorted, largest first), fullest first.

    A filling is dominated when a piece left out fits beside it, or fits in the place of a
    smaller piece or of two pieces that are no larger together.
    """
    found: list[list[int]] = []
    sizes = sorted({x for x in rest if x <= room}, reverse=True)
    have = {s: rest.count(s) for s in sizes}
    steps = 0

    def walk(k: int, left: int, taken: list[int]) -> None:
        nonlocal steps
        steps += 1
        if steps > 40 * limit or len(found) >= limit:
            return
        while k < len(sizes) and sizes[k] > left:
            k += 1
        if k == len(sizes):
            used = {s: taken.count(s) for s in set(taken)}
            spare = [s for s in sizes if have[s] > used.get(s, 0)]
            swaps = set(taken) | {x + y for i, x in enumerate(taken) for y in taken[i + 1:]}
            if not any(s <= left or any(f < s <= f + left or f == s and f not in used for f in swaps) for s in spare):
                found.append(taken)
            return
        for n in range(min(have[sizes[k]], left // sizes[k]), -1, -1):
            walk(k + 1, left - n * sizes[k], taken + [sizes[k]] * n)

    walk(0, room, [])
    return sorted(found, key=sum, reverse=True) or [[]]


def complete(lengths: list[int], capacity: int, most: int, nodes: int = NODES) -> list[list[int]] | None:
    """A packing of ``lengths`` into at most ``most`` sequences (lists of lengths), or None if
    there is none or the node limit ends the search."""
    may_waste = most * capacity - sum(lengths)
    left = nodes

    def search(rest: list[int], waste: int) -> list[list[int]] | None:
        nonlocal left
        if not rest:
            return []
        left -= 1
        for fill in fillings(rest[1:], capacity - rest[0]):
            lost = waste + capacity - rest[0] - sum(fill)
            if lost > may_waste or left <= 0:
                return None
            after = rest[1:]
            for f in fill:
                after.remove(f)
            tail = search(after, lost)
            if tail is not None:
                return [[rest[0], *fill], *tail]
        return None

    return search(sorted(lengths, reverse=True), 0) if may_waste >= 0 else None


def fullest(sizes: list[int], have: dict[int, int], room: int) -> list[int]:
    """Pieces that fill ``room`` as far as any can; where there is a choice, those of the first of
    ``sizes``. Reachable sums are a bit set, which grows size by size until the room
    itself is reached."""
    mask, limit, steps = 1, (1 << (room + 1)) - 1, []
    for s in sizes:
        if s > room:
            continue
        steps.append((s, mask))
        for _ in range(min(have[s], room // s)):
            more = (mask | mask << s) & limit
            if more == mask:
                break
            mask = more
        if mask >> room:
            break
    total, out = mask.bit_length() - 1, []
    for s, before in reversed(steps):
        while not before >> total & 1:
            out.append(s)
            total -= s
    return out


def first_branch(lengths: list[int], capacity: int, seed: int = 0) -> list[list[int]]:
    """The packing that always takes the fullest filling beside the largest piece left (indices).
    Of equally full ones it prefers large pieces, or, with a ``seed``, lengths that many pieces
    left have, by a weighted draw: then no length is left over in number at the end."""
    rng = random.Random(seed)
    at: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        at.setdefault(lengths[i], []).append(i)
    have = {s: len(x) for s, x in at.items()}
    sizes, out = sorted(have, reverse=True), []
    while sizes:
        taken = [sizes[0]]
        have[sizes[0]] -= 1
        order = sorted(sizes, key=lambda s: -have[s] * rng.random()) if seed else sizes
        fill = fullest(order, have, capacity - sizes[0])
        for s in fill:
            have[s] -= 1
        taken += fill
        out.append([at[s].pop() for s in taken])
        if not all(have[s] for s in taken):
            sizes = [s for s in sizes if have[s]]
    return out


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indices into ``lengths``."""
    bins = best_fit(lengths, capacity)
    goal = lower_bound(lengths, capacity) if bins else 0
    for seed in range(BRANCHES):
        if len(bins) > goal:
            other = first_branch(lengths, capacity, seed)
            bins = other if len(other) < len(bins) else bins

    def fewer(part: list[list[int]]) -> list[list[int]] | None:
        better = complete([lengths[i] for b in part for i in b], capacity, len(part) - 1)
        if better is None:
            return None
        at: dict[int, list[int]] = {}
        for b in part:
            for i in b:
                at.setdefault(lengths[i], []).append(i)
        return [[at[x].pop() for x in b] for b in better]

    for turn in range(ROUNDS):
        if len(bins) <= goal:
            break
        bins.sort(key=lambda b: sum(lengths[i] for i in b))
        # sequences that waste least cannot make up for one less unless others beside them waste more
        wasted = [capacity - sum(lengths[i] for i in b) for b in bins]
        if sum(wasted) < capacity:
            break
        gained, rest, k = False, bins, 0
        while len(rest) - k > 1 and len(rest) > goal:
            size = min(SEARCH_BINS, len(rest) - k)
            head = size if turn % 2 == 0 else max(1, size // 2)
            tail = size - head      # on odd rounds half of a set comes from the fuller end, moving on
            where = list(range(k, k + head)) + [len(rest) - 1 - (k + j) % max(1, len(rest) - k - head) for j in range(tail)]
            where = sorted(set(where))
            part = [rest[i] for i in where]
            if sum(capacity - sum(lengths[i] for i in b) for b in part) < capacity:
                break               # later sets waste less still
            better = fewer(part)
            if better is None:
                k += head
                continue
            gained = True
            keep = set(where)
            rest = [b for i, b in enumerate(rest) if i not in keep] + better
        bins = rest
        if not gained and turn % 2:
            break
    return bins


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = 0,
                   keep_ids: bool = False) -> DataFrame:
    """Pieces (see ``tokenise``) with ``sequence_id`` and their ``offset`` in the sequence."""
    pieces = write_table(tokenise(docs, capacity, vocabulary, end_id, keep_ids), "pieces")
    if not keep_ids:
        pieces = pieces.drop("ids")
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") == capacity).select(
        *[c for c in pieces.columns if c != "row"], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-parts.count() // SHARD))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for b, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = (int(key[0]) << 32) + b, at
                at += lengths[i]
        return pdf.drop(columns=["row", "shard"]).assign(sequence_id=seq, offset=off)

    sharded = parts.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    packed = sharded.groupBy("shard").applyInPandas(run, full.schema)
    return packed.union(full)
