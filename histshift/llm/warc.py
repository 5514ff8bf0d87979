r"""WARC archives with segmented records (operator 6).

``write_archives`` writes one record per row: a ``response`` whose block is an HTTP message
with the payload in chunked transfer framing, or a ``revisit`` that refers to the response with
the same payload. Blocks over ``SEGMENT`` bytes are cut into segments: the first is the
response (segment number 1), the others are ``continuation`` records with the origin's
identifier, their number, and on the last one the total length. A file holds at most
``RECORDS`` records, hence at most about RECORDS * SEGMENT bytes, which bounds what a reader
holds. Records are written by Spark's text writer (bytes as they are, the record end as line
separator) and compressed by file, so that any file system that Spark reaches will do.

``read_records`` reads such archives back: whole records where they stand; segments are grouped
by origin identifier, ordered by number and checked (numbers 1 to n, total length) before the
transfer framing is decoded. Only segmented records are shuffled, each group being one page.

Of records with equal payloads of at least ``LEAST`` bytes that with the largest ``page_id`` is
the response. Grouping is on digests; a payload shared by a third of all pages costs one
combined maximum and join rows of a few bytes.

A record's identifier holds the ``page_id``, a digest of url and payload, and a number among equal
rows: rows with one ``page_id``, or with none, have records of their own. Equal rows are counted
before they are written, and more than ``COPIES`` of them are spread over tasks.

Defined cases: a null html is an empty payload; a null ``page_id`` is smaller than any other, and
so is a null url where the ``page_id`` is equal; of equal rows the first is the response; a null url leaves out the target URI, and other bytes than printable ASCII in it are percent
encoded; an empty table gives no records; further columns are ignored. A record that fails a
check (framing, segments, total length, digest) has ``ok`` false and keeps what could be read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histshift.llm.common import bounded_batches, write_table
from histshift.session import fresh_path

LEAST = 1000
CHUNK = 8192
SEGMENT = 32 * 1024
RECORDS = 512
COPIES = 1024
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n")
_FIELDS = ("record_id string, record_type string, target_uri string, refers_to string, declared string, "
           "payload binary, ok boolean")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of ``payload``."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i:i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> tuple[bytes, bool]:
    """(payload, whether the framing was whole); chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            size = int(body[at:line].partition(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return b"".join(out), False
        at = line + 2
        if size == 0:
            return b"".join(out), True
        out.append(body[at:at + size])
        if body[at + size:at + size + 2] != b"\r\n":
            return b"".join(out), False
        at += size + 2


def page_uri(page_id: int | None, mark: str = "0") -> str:
    """The identifier of a row's record; ``mark`` tells the rows of one ``page_id`` apart."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}/{mark}>"


def record(kind: str, record_id: str, block: bytes, **fields: str | None) -> bytes:
    """A WARC record without its closing blank lines."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": "1970-01-01T00:00:00Z"}
    head |= {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    if kind in ("response", "revisit"):
        head["Content-Type"] = "application/http;msgtype=response"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(own: str, url: str | None, payload: bytes, refers_to: str | None, segment: int) -> Iterator[bytes]:
    """The records of one row (identifiers as of ``page_uri``): a revisit, a response, or a response
    and its continuations."""
    fields = {"WARC_Target_URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
              "WARC_Payload_Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()}
    if refers_to is not None:
        yield record("revisit", own, _HTTP, WARC_Refers_To=refers_to, WARC_Profile=PROFILE, **fields)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield record("response", own, block, **fields)
        return
    yield record("response", own, block[:segment], WARC_Segment_Number="1", **fields)
    count = -(-len(block) // segment)
    for k in range(2, count + 1):
        yield record("continuation", f"{own[:-1]}:{k}>", block[(k - 1) * segment:k * segment], WARC_Segment_Number=str(k),
                     WARC_Segment_Origin_ID=own, WARC_Segment_Total_Length=str(len(block)) if k == count else None)


def uri_of(base: Column, copy: Column) -> Column:
    return F.concat(base, copy.cast("string"), F.lit(">"))


def keyed_rows(pages: DataFrame) -> DataFrame:
    """(base, page_id, url, payload, digest, size) of each row; ``base``, the same for equal rows only,
    begins the row's identifier: ``page_uri`` with url and payload digest as its mark."""
    html, url = F.coalesce("html", F.lit("")).cast("binary"), F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("payload"),
                        F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    mark = F.md5(F.concat(F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")), F.lit(" "), "digest"))
    base = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("/"), mark, F.lit("."))
    return rows.withColumn("base", base)


def revisits(counts: DataFrame) -> DataFrame:
    """(base, refers_to) of payloads that several rows share: the identifier of the response among
    them. ``counts``: base, page_id, url, digest, size, n."""
    # the greatest (page_id, url), nulls below all else
    greatest = F.max(F.struct(F.col("page_id").isNotNull(), "page_id", F.col("url").isNotNull(), "url", "base")).alias("m")
    shared = (counts.where(F.col("size") >= LEAST).groupBy("digest", "size").agg(greatest, F.sum("n").alias("n"))
              .where("n > 1").select("digest", "size", uri_of(F.col("m.base"), F.lit(0)).alias("refers_to")))
    return counts.join(shared, ["digest", "size"]).select("base", "refers_to")


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, records: int = RECORDS,
                   compression: str = "gzip") -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path`` (``compression``: gzip or none)."""
    bounded_batches(pages.sparkSession)
    rows = keyed_rows(pages)
    counts = write_table(rows.groupBy("base").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "digest", "size")],
                                                  F.count("*").alias("n")), "row-counts")
    refers = write_table(revisits(counts), "revisits")
    most = counts.agg(F.max("n")).first()[0] or 1

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("own", "url", "payload", "refers_to")))
            out = [r for page in rows for r in page_records(*page, segment)]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    once = rows.select("base", "url", "payload", F.lit(1).cast("long").alias("n"))
    if most > 1:        # equal rows meet, to be numbered
        once = rows.groupBy("base").agg(F.first("url").alias("url"), F.first("payload").alias("payload"), F.count("*").alias("n"))
    named = once.join(refers, "base", "left")
    first = F.lit(0).cast("long")
    if most > COPIES:   # blocks of equal rows are dealt anew
        blocks = F.sequence(first, F.floor((F.col("n") - 1) / COPIES))
        named = named.withColumn("block", F.explode(blocks)).repartition("base", "block")
        first = F.col("block") * COPIES
    each = named.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("n"), first + COPIES) - 1)))
    own = uri_of(F.col("base"), F.col("copy"))
    lines = each.select(own.alias("own"), "url", "payload", F.when(own != F.col("refers_to"), F.col("refers_to")).alias("refers_to"))
    (lines.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write
     .option("lineSep", END.decode()).option("maxRecordsPerFile", records).option("compression", compression).text(path))


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of an archive, gzipped or plain."""
    if content.startswith(b"\x1f\x8b"):
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        stop = content.find(END, at)
        if stop < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, content[stop + 4:stop + 4 + size]
        at = stop + 4 + size + len(END)


def http_payload(block: bytes) -> tuple[bytes, bool]:
    head, found, body = block.partition(END)
    if b"transfer-encoding: chunked" in head.lower():
        return dechunk(body)
    return body, bool(found)


def _row(fields: dict[str, str], block: bytes, ok: bool = True) -> tuple:
    payload, whole = http_payload(block)
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    declared = base64.b32decode(declared).hex() if declared else None
    kind = fields["warc-type"]
    if kind == "revisit":
        payload, whole = None, True
    else:
        whole = whole and declared in (None, hashlib.sha1(payload).hexdigest())
    return fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), declared, payload, ok and whole


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(),) * 5 + (pa.binary(), pa.bool_())
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)


def _whole(batches):
    """The records that are not segmented, some at a time."""
    for b in batches:
        for content in b.column("content"):
            rows, held = [], 0
            for fields, block in parse_records(content.as_py()):
                if "warc-segment-number" not in fields:
                    rows.append(_row(fields, block))
                    held += len(block)
                    if held > 1 << 22:
                        yield _table(rows)
                        rows, held = [], 0
            yield _table(rows)


def _segments(batches):
    names = ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to", "warc-payload-digest")
    for b in batches:
        for content in b.column("content"):
            rows = [(f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]),
                     int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                     {n: f[n] for n in names if n in f} if f["warc-segment-number"] == "1" else None, block)
                    for f, block in parse_records(content.as_py()) if "warc-segment-number" in f]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())
            cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in kinds]
            cols[3] = [None if m is None else list(m.items()) for m in cols[3]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["origin", "number", "total", "fields", "block"])


def _reassemble(batches):
    for b in batches:
        rows = []
        for r in b.to_pylist():
            block = b"".join(p["block"] for p in r["parts"])
            ok = [p["number"] for p in r["parts"]] == list(range(1, len(r["parts"]) + 1)) and r["total"] == len(block)
            fields = dict(r["fields"] or [("warc-record-id", r["origin"]), ("warc-type", "response")])
            rows.append(_row(fields, block, ok and r["fields"] is not None))
        yield _table(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, segments joined: record_id, record_type, target_uri, refers_to,
    declared (payload digest in the header, hex), payload (null for revisits), ok."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = files.mapInArrow(_segments, "origin string, number int, total long, fields map<string,string>, block binary")
    groups = parts.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.first("fields", ignorenulls=True).alias("fields"))
    return files.mapInArrow(_whole, _FIELDS).unionByName(
        groups.select("origin", "parts", "total", "fields").mapInArrow(_reassemble, _FIELDS))


def archive_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages``, read the archives back, and describe the payload of each row."""
    path = fresh_path(spark, "warc")
    write_archives(pages, path)

    page = F.expr("try_cast(regexp_extract(record_id, '<urn:x-page:(-?[0-9]+)/', 1) as bigint)")
    back = read_records(spark, path).select(
        "record_id", page.alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "declared").alias("payload_digest"), "record_type", "refers_to", "ok")
    back = write_table(back, "warc-records")
    origin = back.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"))
    told = back.where("record_type = 'revisit'").join(origin, "refers_to", "left").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type",
        F.col("_page").alias("refers_to"), F.coalesce(F.col("ok") & (F.col("_digest") == F.col("payload_digest")), F.lit(False)).alias("ok"))
    return back.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(told, allowMissingColumns=True).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok")
