"""SentencePiece encoding with n-best segmentations, and decoding (operator 5).

A text becomes ``U+2581`` + the text with spaces as ``U+2581``; its lattice holds every piece of the
vocabulary at every place it occurs, with the piece's score, and for a character in no piece
of its own an edge of its UTF-8 byte pieces at ``UNKNOWN`` below the least score.

Method. Forward Viterbi gives the best score from the start to each place. These scores are
exact heuristics for an A-star search that runs backward from the end: a hypothesis is a
suffix, its priority the suffix's score plus the Viterbi score of its left end, so complete
segmentations leave the queue in order of score (ties: the one that has come further, then
the smaller ids from the right).

The lattice falls apart between two characters that stand side by side in no piece, for no
edge crosses there: before each word (no piece has ``U+2581`` after another character; for a
vocabulary with such pieces whole texts are taken), and inside words between most letters and
signs. Each distinct part is searched once (while a bounded cache holds it), and the n best of
a word, and of a text, are merged from their parts' n best: the next best differ from the best
in a few parts, and only the ``n - 1`` least losses can matter. Therefore the forward pass runs
over all new parts of a batch at once, as array operations (with a backward pass, which gives
the loss of each part's second best), and the A-star search only on words that can matter.

Defined cases: null and empty texts have no pieces and one segmentation of score 0; texts with
fewer than n segmentations return those they have; a literal ``U+2581`` is encoded by its bytes,
so that decoding gives back any text exactly; equal or null ``doc_id`` rows are encoded each by
itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from histshift.llm.common import text_bytes
from histshift.llm.packing import vocabulary_path
from histshift.llm.words import mix

MODEL = "piece_bpe_32k.model"
N_BEST = 4
UNKNOWN = 10.0
#: Pieces scored no higher are place holders (runs of spaces in some vocabularies) and not used;
#: a single space so scored counts as the least scored piece.
NO_SCORE = -1e8
SPACE = "▁"
CACHE, CACHED_CHARS = 600_000, 48
LONG = 512
#: Texts whose new words are prepared together, and the most characters of one forward pass.
TOGETHER, PASS = 200, 1 << 24
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

Segmentation = tuple[float, tuple[int, ...]]


@cache
def lattice_of(model: str) -> "Lattice":
    """The lattice of a vocabulary, one for the life of a Python worker: its tables are made, and
    words met before are known, for all tasks that the worker runs."""
    return Lattice(model)


class Lattice:
    """The vocabulary: pieces with ids and scores, and the byte pieces."""

    def __init__(self, model: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model))
        ids = range(sp.vocab_size())
        self.text = [sp.id_to_piece(i) for i in ids]
        self.byte = {int(self.text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        usable = {self.text[i]: ((i,), sp.get_score(i)) for i in ids
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and sp.get_score(i) > NO_SCORE}
        if SPACE not in usable and sp.piece_to_id(SPACE) != sp.unk_id():
            usable[SPACE] = ((sp.piece_to_id(SPACE),), min((s for _, s in usable.values()), default=0.0))
        self.pieces = usable
        # every beginning of a piece, with the piece's (ids, score) where it is one itself
        self.prefixes = {p[:k]: () for p in usable for k in range(1, len(p))} | usable
        self.unknown = min((s for _, s in usable.values()), default=0.0) - UNKNOWN
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in usable)
        self.pairs = {p[i:i + 2] for p in usable for i in range(len(p) - 1)}
        self.pair_keys = Hashes(mix(_pair(*np.array([[ord(p[0]), ord(p[1])] for p in self.pairs] or [[0, 0]], np.uint64).T)))
        literal = (self.unknown, _packed([self.byte[b] for b in SPACE.encode()]), math.inf)
        self.tables = [self._table(k) for k in range(1, max(map(len, usable), default=1) + 1)]
        self.spelling = [t.replace(SPACE, " ").encode() for t in self.text]
        for b, i in self.byte.items():
            self.spelling[i] = bytes([b])
        self.width = np.array([len(x) for x in self.spelling])
        #: Of known words, and of a literal U+2581 (None): best score, its ids as little-endian
        #: 32-bit numbers, loss of the second best.
        self.best: dict[str | None, tuple[float, bytes, float]] = {None: literal}
        self.best_parts: dict[str, tuple[float, bytes, float]] = {}
        self.passing: list[tuple[str, list[str] | None]] = []
        self.words: dict[tuple[str, int], list[Segmentation]] = {}
        self.parts: dict[tuple[str, int], list[Segmentation]] = {}

    def n_best(self, text: str, n: int) -> list[Segmentation]:
        """The ``n`` best (score, ids) of ``text``, best first."""
        find, size = self.prefixes.get, len(text)
        forward = [-math.inf] * (size + 1)
        forward[0] = 0.0
        incoming: list[list] = [[] for _ in range(size + 1)]     # edges by their end: (start, ids, score)
        for start in range(size):
            at, end, hit = forward[start], start + 1, find(text[start])
            if not hit:
                hit_ids = tuple([self.byte[b] for b in text[start].encode()])
                incoming[end].append((start, hit_ids, self.unknown))
                forward[end] = max(forward[end], at + self.unknown)
            while hit is not None:
                if hit:
                    incoming[end].append((start, *hit))
                    if at + hit[1] > forward[end]:
                        forward[end] = at + hit[1]
                end += 1
                hit = find(text[start:end]) if end <= size else None
        push, pop = heapq.heappush, heapq.heappop
        heap: list[tuple] = [(-forward[size], size, (), 0.0, None)]
        out: list[Segmentation] = []
        while heap:
            _, at, ids, behind, suffix = pop(heap)
            link = (ids, suffix)
            if at:
                for start, edge, score in incoming[at]:
                    total = behind + score
                    push(heap, (-total - forward[start], start, edge, total, link))
                continue
            whole: list[int] = []
            while link is not None:
                whole += link[0]
                link = link[1]
            out.append((behind, tuple(whole)))
            if len(out) == n:
                break
        return out

    def _table(self, length: int) -> tuple["Hashes", np.ndarray, np.ndarray]:
        """(hashes, id or -1, score) of all beginnings of pieces of one length, by hash."""
        texts = [t for t in self.prefixes if len(t) == length]
        h = np.zeros(len(texts), np.uint64)
        for k in range(length):
            h = _roll(h, np.array([ord(t[k]) for t in texts], np.uint64))
        known = Hashes(h)
        hits = [self.prefixes[t] or ((-1,), 0.0) for t in texts]
        # one more for what is not found
        return (known, np.r_[np.array([ids[0] for ids, _ in hits], np.int64)[known.order], -1],
                np.r_[np.array([score for _, score in hits])[known.order], 0.0])

    def viterbi(self, texts: list[str]) -> list[tuple[float, bytes, float]]:
        """(best score, its ids, loss of the second best or inf) of each non-empty text."""
        size = np.array([len(t) for t in texts])
        first = np.r_[0, np.cumsum(size)]
        if first[-1] > PASS and len(texts) > 1:
            half = min(max(1, int(np.searchsorted(first, first[-1] // 2))), len(texts) - 1)
            return self.viterbi(texts[:half]) + self.viterbi(texts[half:])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), size)
        stop = first[1:][row]
        edges = []
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for length, (table, ids, scores) in enumerate(self.tables, 1):
            h = _roll(h, chars[at + length - 1])
            k, ok = table.find(h)
            piece = ok & (ids[k] >= 0)
            edges.append((at[piece], at[piece] + length, ids[k[piece]], scores[k[piece]]))
            if length == 1:     # characters in no piece of their own; ids -1 - character for now
                lone = np.flatnonzero(~piece)
                edges.append((lone, lone + 1, -1 - chars[lone].astype(np.int64), np.full(len(lone), self.unknown)))
            ok &= at + length < stop[at]
            at, h = at[ok], h[ok]
            if not len(at):
                break
        start, end, ids, score = (np.concatenate(c) for c in zip(*edges))
        # one node per place, a further one behind each text
        whose = row[start]
        a, b = start + whose, end + whose
        origin, goal = first[:-1] + np.arange(len(texts)), first[1:] + np.arange(len(texts))
        forward, back = np.full(len(chars) + len(texts), -np.inf), np.zeros(len(chars) + len(texts), np.int64)
        forward[origin] = 0.0
        rear = forward.copy()
        rear[:] = -np.inf
        rear[goal] = 0.0
        for order, cut in _waves(end - first[whose], (a, b)):
            for lo, hi in cut:
                e = order[lo:hi]
                begin = np.flatnonzero(np.r_[True, b[e[1:]] != b[e[:-1]]])
                value = forward[a[e]] + score[e]
                top = np.maximum.reduceat(value, begin)
                forward[b[e[begin]]] = top
                same = value == np.repeat(top, np.diff(np.r_[begin, len(e)]))
                back[b[e[begin]]] = e[np.minimum.reduceat(np.where(same, np.arange(len(e)), len(e)), begin)]
        for order, cut in _waves(first[1:][whose] - start, (b, a)):
            for lo, hi in cut:
                e = order[lo:hi]
                begin = np.flatnonzero(np.r_[True, a[e[1:]] != a[e[:-1]]])
                rear[a[e[begin]]] = np.maximum.reduceat(rear[b[e]] + score[e], begin)
        on_path, node = np.zeros(len(a), bool), goal
        while len(node):
            e = back[node]
            on_path[e] = True
            node = a[e][a[e] != origin[whose[e]]]
        total = forward[goal]
        second = np.full(len(texts), -np.inf)
        np.maximum.at(second, whose[~on_path], (forward[a] + score + rear[b])[~on_path])
        path = np.flatnonzero(on_path)
        path = path[np.argsort(start[path], kind="stable")]
        counts = np.cumsum(np.bincount(whose[path], minlength=len(texts))).tolist()
        taken, out, lo = ids[path], [], 0
        spelt = taken.astype("<u4").tobytes()
        odd = set(np.flatnonzero(np.bincount(whose[path[taken < 0]], minlength=len(texts))).tolist()) if taken.min() < 0 else ()
        for k, (t, l2, hi) in enumerate(zip(total.tolist(), (total - second).tolist(), counts)):
            if k in odd:
                found = _packed(chain.from_iterable([i] if i >= 0 else [self.byte[c] for c in chr(-1 - i).encode()]
                                                    for i in taken[lo:hi].tolist()))
            else:
                found = spelt[4 * lo:4 * hi]
            out.append((t, found, l2))
            lo = hi
        return out

    def prepare(self, words: set[str]) -> None:
        """Best segmentations of new words, by one pass over all that is new in them: words of one
        part, and the new parts of the others."""
        best, known = self.best, self.best_parts
        if len(best) > CACHE:
            literal = best[None]
            best.clear()
            best[None] = literal
        if len(known) > CACHE:
            known.clear()
        new = list(words.difference(best))
        split = self.split(new)
        whole = [w for w, ps in zip(new, split) if ps is None]
        missing = list({p for ps in split if ps is not None for p in ps}.difference(known))
        names = whole + missing
        sizes = list(map(len, names))
        if sizes and max(sizes) > LONG:     # one by one: waves over few long parts would be narrow
            short = [p for p, n in zip(names, sizes) if n <= LONG]
            at = dict(zip(short, self.viterbi(short))) if short else {}
            for p, n in zip(names, sizes):
                if n > LONG:
                    top = self.n_best(p, 2)
                    at[p] = (top[0][0], _packed(top[0][1]), top[0][0] - top[1][0] if len(top) > 1 else math.inf)
            found = [at[p] for p in names]
        else:
            found = self.viterbi(names) if names else []
        best.update(zip(whole, found))
        known.update(zip(missing, found[len(whole):]))
        for w, ps in zip(new, split):
            if ps is not None:
                score, ids, loss = zip(*[known[p] for p in ps])
                best[w] = (sum(score), b"".join(ids), min(loss))
        self.passing = [(w, ps) for w, ps in zip(new, split) if len(w) > CACHED_CHARS]

    def forget_long(self) -> None:
        """Drop the long ones of the words prepared last, and their parts."""
        for w, ps in self.passing:
            self.best.pop(w, None)
            for p in ps or ():
                self.best_parts.pop(p, None)
        self.passing = []

    def split(self, words: list[str]) -> list[list[str] | None]:
        """``parts_in`` of many words, None for those of one part; pairs are looked up all at once."""
        out: list[list[str] | None] = [None] * len(words)
        ends = np.cumsum([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(chars) < 2:
            return out
        cut = ~self.pair_keys.find(mix(_pair(chars[:-1], chars[1:])))[1]
        cut[ends[:-1] - 1] = False
        places = np.flatnonzero(cut) + 1
        whose = np.searchsorted(ends, places, side="right")
        begin = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(whose) else whose
        local = (places - np.r_[0, ends][whose]).tolist()
        for k, lo, hi in zip(whose[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(places)]):
            w, cuts = words[k], local[lo:hi]
            out[k] = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)])]
        return out

    def parts_in(self, word: str) -> list[str]:
        """The word cut wherever two neighbours stand side by side in no piece."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def word(self, text: str, n: int) -> list[Segmentation]:
        """The ``n`` best of a word, from those of its parts."""
        found = self.words.get((text, n))
        if found is None:
            parts = [self._part(p, n) for p in self.parts_in(text)]
            found = parts[0] if len(parts) == 1 else combined(parts, n)
            _keep(self.words, text, n, found)
        return found

    def _part(self, text: str, n: int) -> list[Segmentation]:
        found = self.parts.get((text, n))
        if found is None:
            found = self.n_best(text, n)
            _keep(self.parts, text, n, found)
        return found


def _keep(cache: dict, text: str, n: int, found: list[Segmentation]) -> None:
    if len(text) <= CACHED_CHARS:
        if len(cache) >= CACHE:
            cache.clear()
        cache[text, n] = found


def merge(parts: list[list[Segmentation]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The ``n`` best choices of one segmentation per part: (loss, ((part, choice), ...)).

    Choices not listed are 0. Only parts with the ``n - 1`` least first losses can change: any
    other change is beaten by ``n - 1`` single ones and by the best itself.
    """
    first = [(p[0][0] - p[1][0], k) for k, p in enumerate(parts) if len(p) > 1]
    near = sorted(k for _, k in heapq.nsmallest(n - 1, first))
    best: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for k in near:
        options = [(loss + parts[k][0][0] - s[0], chosen + (((k, c),) if c else ()))
                   for loss, chosen in best for c, s in enumerate(parts[k][:n])]
        best = heapq.nsmallest(n, options)
    return best


def parts_of(text: str, lattice: Lattice) -> list[str | None]:
    """The independent parts of a text's lattice; None stands for a literal U+2581."""
    if not text:
        return []
    if SPACE in text:
        out: list[str | None] = []
        for k, piece in enumerate(text.split(SPACE)):
            out += [None] if k else []
            # spaces as marks; only the very start of a text gets one added
            body = (SPACE if k == 0 else "") + piece.replace(" ", SPACE)
            out += _PART.findall(body) if lattice.splits else [body] if body else []
        return out
    marked = SPACE + text.replace(" ", SPACE)
    return _PART.findall(marked) if lattice.splits else [marked]


def choices_of(names: list[str | None], lattice: Lattice, n: int
               ) -> tuple[list[bytes], list[tuple[float, dict[int, bytes]]]]:
    """Of prepared parts in a row: the best ids by part, and of the ``n`` best segmentations,
    best first, the score and the ids of the parts that differ from the best, by place."""
    if not names:
        return [], [(0.0, {})]
    scores, base, losses = zip(*map(lattice.best.__getitem__, names))
    best = sum(scores)
    order = np.argsort(np.array(losses), kind="stable")[:n - 1].tolist()
    near = sorted([i for i in order if losses[i] < math.inf])
    choices = [lattice.word(names[i], n) for i in near]
    return list(base), [(best - loss, {near[k]: _packed(choices[k][c][1]) for k, c in chosen}) for loss, chosen in merge(choices, n)]


def n_best_of(names: list[str | None], lattice: Lattice, n: int) -> list[Segmentation]:
    """The ``n`` best (score, ids) of prepared parts in a row, best first."""
    base, found = choices_of(names, lattice, n)
    out = []
    for score, other in found:
        ids = list(base)
        for k, part in other.items():
            ids[k] = part
        out.append((score, tuple(np.frombuffer(b"".join(ids), "<u4").tolist())))
    return out


def encode(text: str, lattice: Lattice, n: int = N_BEST) -> list[Segmentation]:
    """The ``n`` best segmentations of a whole text, best first."""
    names = parts_of(text, lattice)
    words = {w for w in names if w is not None}
    lattice.prepare(words)
    out = n_best_of(names, lattice, n)
    lattice.forget_long()
    return out


def combined(parts: list[list[Segmentation]], n: int) -> list[Segmentation]:
    """The ``n`` best segmentations of parts in a row."""
    open_ = [k for k, p in enumerate(parts) if len(p) > 1]
    if len(open_) <= 1:     # only one part has a choice
        k = open_[0] if open_ else 0
        before = tuple(chain.from_iterable([p[0][1] for p in parts[:k]]))
        after = tuple(chain.from_iterable([p[0][1] for p in parts[k + 1:]]))
        rest = sum([p[0][0] for p in parts]) - (parts[k][0][0] if parts else 0.0)
        return [(rest + score, before + ids + after) for score, ids in (parts[k] if parts else [(0.0, ())])]
    best = sum([p[0][0] for p in parts])
    out, base = [], [p[0][1] for p in parts]
    for loss, chosen in merge(parts, n):
        ids = base
        if chosen:
            ids = list(base)
            for k, c in chosen:
                ids[k] = parts[k][c][1]
        out.append((best - loss, tuple(chain.from_iterable(ids))))
    return out


def decode(ids: tuple[int, ...] | list[int], lattice: Lattice) -> str:
    """The text of ``ids``: byte pieces as UTF-8, marks as spaces, less the one at the start."""
    return b"".join([lattice.spelling[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _packed(ids) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two characters as one number."""
    return (a << np.uint64(21)) | b


class Hashes:
    """Sorted 64-bit hashes, found by their upper bits: about one hash begins with each."""

    def __init__(self, h: np.ndarray):
        self.order = np.argsort(h)
        bits = max(1, int(len(h)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.sorted = np.r_[h[self.order], np.uint64(2 ** 64 - 1)]
        self.first = np.searchsorted(self.sorted[:-1] >> self.shift, np.arange(1 << bits, dtype=np.uint64))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the sorted hashes, whether it is there) of each of ``h``."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        met = self.sorted[at]
        todo = np.flatnonzero(met < h)
        while len(todo):
            at[todo] += 1
            met[todo] = self.sorted[at[todo]]
            todo = todo[met[todo] < h[todo]]
        return at, (met == h) & (at < len(self.sorted) - 1)


def _roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1))


def _waves(place: np.ndarray, by: tuple[np.ndarray, np.ndarray]):
    """Edges ordered by place, then by node, with the bounds of each place: all edges of one
    place can be taken at once, when those of smaller places have been."""
    order = np.argsort((place << 50) | (by[1] << 25) | by[0])      # no two edges share both nodes
    edge = np.flatnonzero(np.r_[True, place[order[1:]] != place[order[:-1]], True]).tolist()
    yield order, list(zip(edge[:-1], edge[1:]))


def _encoded(batch: pa.RecordBatch, lattice: Lattice, n: int, found=n_best_of):
    """(doc_id, text bytes, what ``found`` gives for its parts) of each row; the batch's new
    words are prepared together."""
    texts = [t.as_py() for t in batch.column("_text")]
    names = [parts_of(t.decode(), lattice) for t in texts]
    ids = batch.column("doc_id").to_pylist()
    for lo in range(0, len(names), TOGETHER):
        part = slice(lo, lo + TOGETHER)
        lattice.prepare(set().union(*names[part]))
        for doc, text, ws in zip(ids[part], texts[part], names[part]):
            yield doc, text, found(ws, lattice, n)
        lattice.forget_long()


_ENCODED = "doc_id long, rank int, score double, ids array<int>"


def encode_texts(docs: DataFrame, model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """(doc_id, rank, score, ids), up to ``n`` rows per row of ``docs``, rank 1 the best."""
    def run(batches):
        lattice = lattice_of(model)
        for b in batches:
            rows = [(doc, rank, score, list(ids)) for doc, _, found in _encoded(b, lattice, n)
                    for rank, (score, ids) in enumerate(found, 1)]
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "rank", "score", "ids"])
    return text_bytes(docs, "doc_id").mapInArrow(run, _ENCODED)


def digests(base: list[bytes], found: list[tuple[float, dict[int, bytes]]], text: bytes,
            lattice: Lattice) -> list[tuple[int, int, bool]]:
    """(n_pieces, ids_crc32, whether it decodes to ``text``) of each segmentation of ``choices_of``.

    The ids and the spelling of the best are made whole; those of the others are joined from
    its bytes and the parts that differ, and digested and compared whole.
    """
    spell, want = lattice.spelling, b" " + text if text else b""
    ids = b"".join(base)
    best = np.frombuffer(ids, "<u4")
    spelt = b"".join(map(spell.__getitem__, best.tolist()))
    bounds = {}     # of the parts that differ: from and to which piece and byte of the best
    piece = byte = last = 0
    for k in sorted({k for _, other in found for k in other}):
        start = piece + sum(map(len, base[last:k])) // 4
        end = start + len(base[k]) // 4
        left = byte + int(lattice.width[best[piece:start]].sum())
        byte = left + int(lattice.width[best[start:end]].sum())
        bounds[k] = (start, end, left, byte)
        piece, last = end, k + 1
    out = []
    for _, other in found:
        codes, texts, piece, byte = [], [], 0, 0
        for k in sorted(other):
            start, end, left, right = bounds[k]
            codes += [ids[4 * piece:4 * start], other[k]]
            texts += [spelt[byte:left], *map(spell.__getitem__, np.frombuffer(other[k], "<u4").tolist())]
            piece, byte = end, right
        whole = b"".join([*codes, ids[4 * piece:]])
        out.append((len(whole) // 4, zlib.crc32(whole), b"".join([*texts, spelt[byte:]]) == want))
    return out


def encode_digest(docs: DataFrame, model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pieces and ids_crc32 (unsigned, little-endian 32-bit ids) of
    the best segmentation, whether each of the n best decodes to the text (``ok``), and, as
    arrays over the ranks, scores, rank_pieces, rank_crc32 and rank_ok."""
    def run(batches):
        lattice = lattice_of(model)
        for b in batches:
            rows = []
            for doc, text, (base, found) in _encoded(b, lattice, n, choices_of):
                pieces, crcs, oks = map(list, zip(*digests(base, found, text, lattice)))
                rows.append((doc, pieces[0], crcs[0], [s for s, _ in found], all(oks), pieces, crcs, oks))
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), longs, longs, pa.list_(pa.bool_()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)],
                                  names=["doc_id", "n_pieces", "ids_crc32", "scores", "ok", "rank_pieces", "rank_crc32", "rank_ok"])
    return text_bytes(docs, "doc_id").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, ok boolean, "
             "rank_pieces array<long>, rank_crc32 array<long>, rank_ok array<boolean>")
