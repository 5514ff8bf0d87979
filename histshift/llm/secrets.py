r"""Secret scans with a token-efficiency test (operator 7).

Base kinds, leftmost non-overlapping per kind: ``assign`` (a name such as ``password``, then
``:`` or ``=``, then 12 or more characters), ``access`` (``AKIA`` and 14 or more capitals or
digits) and ``hex`` (16 or more lower-case hex digits).

Method. Runs of 20 or more characters ``[A-Za-z0-9+/_=-]`` that hold a letter are encoded with
a byte-level BPE vocabulary. Words and identifiers take few tokens; random strings fall apart
into short ones, so that ``characters per token <= MAX_RATIO`` exposes them (kind ``random``).
The ratio is taken over the whole run and, where that does not expose it, over the stretches
between its plain words and over each part between separators (of 20 or more characters too),
so that words beside a secret do not hide it. Left out are known digests (hex of 32, 40, 56,
64, 96 or 128 digits), UUIDs, the host of URLs (``scheme://`` or ``www.``; their user, query and
fragment are scored, and each segment of their path by itself, so that slashes don't join short
segments), and identifiers (alphabetic parts joined by separators with
short numbers) whose words are dictionary-like, that is above the ratio themselves. Base spans
are cut out of a run before the test. Runs are encoded in pieces of ``PIECE`` characters so
that time is in proportion to length.

A vectorised search first finds the texts where a kind can match at all; those are searched
whole. Spans are code points, end exclusive.

Defined cases: null and empty texts have no spans; equal or null ``doc_id`` rows are each
scanned by themselves; further columns are kept by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histshift.llm.common import arrow_rows, bounded_batches
from histshift.llm.packing import vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_RATIO = 2.0
PIECE = 256
KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")     # runs of 16 or more, each whole
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PART = re.compile(r"[A-Za-z0-9]+")
_WORD = re.compile(r"[A-Za-z]{2,}")
LEAST = 20
#: The user of a URL (group 1, where present), its host, then its path (group 2, where present).
_URL = re.compile(r"(?:(?<=[A-Za-z0-9])://([^\s/?#@]*@)?|(?<![A-Za-z0-9])www\.)"
                  r"[A-Za-z0-9._~%!$&*+=:@-]*(/[A-Za-z0-9._~%!$&*+=:@/-]*)?")
#: What a text must hold for a kind to match; searched over whole columns.
_HINTS = {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
          "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "random": r"[A-Za-z0-9+/_=-]{20}"}
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
_NAME = re.compile(r"(?:[A-Za-z]+|[0-9]{1,8})(?:[_/=-]+(?:[A-Za-z]+|[0-9]{1,8}))*[_/=-]*")


def base_spans(text: str, hints: dict[str, bool] | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, in no order."""
    on = hints or dict.fromkeys(KINDS, True)
    out = []
    if on["assign"]:
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if on["access"]:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if on["hex"]:
        out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def _per_token(text: str, encode) -> float:
    return len(text) / sum(len(encode(text[k:k + PIECE])) for k in range(0, len(text), PIECE))


def _plain(text: str, encode) -> bool:
    """Whether the words of a text are dictionary-like (capitals as small letters)."""
    found = _WORD.findall(text)
    tokens = sum(len(w) / _per_token(w.lower() if w.isupper() else w, encode) for w in found)
    return sum(map(len, found)) > MAX_RATIO * tokens


def _exposed(text: str, encode) -> bool:
    """Whether a run, or a part of one, is random by the token-efficiency test."""
    if len(text) < LEAST or not any(c.isalpha() for c in text) or _DIGEST.fullmatch(text) or _UUID.fullmatch(text):
        return False
    return _per_token(text, encode) <= MAX_RATIO and not (_NAME.fullmatch(text) and _plain(text, encode))


def _random_in(run: str, encode) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: all of it, or stretches, or parts."""
    if _exposed(run, encode):
        return [(0, len(run))]
    stretches: list[list[tuple[int, int]]] = [[]]
    for m in _PART.finditer(run):
        if len(m[0]) > 2 and m[0].isalpha() and _plain(m[0], encode) or _DIGEST.fullmatch(m[0]):
            stretches.append([])
        else:
            stretches[-1].append(m.span())
    out = []
    for parts in filter(None, stretches):
        whole = (parts[0][0], parts[-1][1])
        out += [(a, b) for a, b in ([whole] if _exposed(run[slice(*whole)], encode) else parts) if _exposed(run[a:b], encode)]
    return out


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text``, of the same length, with the spans as spaces."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out += [text[at:max(start, at)], " " * (end - max(start, at))]
            at = end
    return "".join(out) + text[at:]


def random_runs(text: str, encode, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans that the token-efficiency test adds; ``encode``: text to token ids."""
    closed = [(s, e) for s, _, e in taken]
    for m in _URL.finditer(text):
        closed.append((m.end(1) if m[1] else m.start(), m.start(2) if m[2] else m.end()))
        closed += [(k, k + 1) for k in range(*m.span(2)) if text[k] == "/"]
    return [(m.start() + a, "random", m.start() + b) for m in _RUN.finditer(_blanked(text, closed))
            for a, b in _random_in(m[0], encode)]


@cache
def _encoder(vocabulary: str):
    """Text to token ids; one for the life of a Python worker."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(vocabulary_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


def _scan(texts: pa.Array, encode) -> list[list[tuple[int, str, int]]]:
    """Sorted spans of each text (nulls: none)."""
    hints = {k: pc.match_substring_regex(texts, p).fill_null(False).to_numpy(zero_copy_only=False)
             for k, p in _HINTS.items()}
    any_ = hints["assign"] | hints["access"] | hints["hex"] | hints["random"]
    out: list[list[tuple[int, str, int]]] = []
    for i in range(len(texts)):
        if not any_[i]:
            out.append([])
            continue
        text = texts[i].as_py()
        spans = base_spans(text, {k: bool(v[i]) for k, v in hints.items()})
        if hints["random"][i]:
            spans += random_runs(text, encode, spans)
        out.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))
    return out


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, spans: array of kind, start, end), one row per row of ``docs``."""
    def run(batches):
        encode = _encoder(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in _scan(b.column("text"), encode)]
            yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "spans": pa.array(spans, kind)})
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans as text."""
    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = scan_secrets(docs, vocabulary)
    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    count = {k: of(k) for k in KINDS}
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count["assign"], count["access"], count["hex"],
                        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
                        count["random"])


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """``text`` with every span, overlapping ones together, replaced by one mask."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with all secrets in ``text`` masked; ``n_chars``, where present, is counted anew."""
    def run(batches):
        encode = _encoder(vocabulary)
        for b in batches:
            texts = b.column("_text")
            out = [masked(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, _scan(texts, encode))]
            yield b.set_column(b.schema.get_field_index("_text"), "_text", pa.array(out, pa.string()))
    bounded_batches(docs.sparkSession)
    names = {c: f"c{k}" if c != "text" else "_text" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    done = plain.mapInArrow(run, plain.schema)
    cols = {c: F.col(n).alias(c) for c, n in names.items()}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*cols.values())
