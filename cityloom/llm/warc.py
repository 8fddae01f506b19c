"""WARC: archives of captures, and their assembly into one nested row per capture.

Writing.  Each page becomes a transaction of three records: a response (or, where an
equal payload is already held by the capture with the largest page_id, a revisit that
refers to the record of that capture), a request and a metadata record, the latter two
concurrent to the first.  A warcinfo record comes before all, so that Spark, which writes its
first file even of no rows, leaves no archive without records.  Records are plain text that blank lines end, so Spark's own text
writer lays them down in any store and commits them atomically, and any reader can take
a record by its offset.  Only pages whose payload another page may share are shuffled.

Reading.  Archives are read as binary files and cut by Content-Length; whole files in
gzip are read as well.  A file is held in memory as a whole, of ``FILE_RECORDS`` records
at most.  Responses and revisits are joined to requests and metadata by the identifiers
in WARC-Concurrent-To, and revisits to what they refer to by record identifiers; nothing
else brings them together.

Defined results: a null html is an empty payload; a null page_id or url is left out
of the records and read as null; among rows of equal payload that repeat the largest
page_id all are responses, and revisits refer to one of them; fully repeated rows give as
many captures, each with record identifiers of its own; a payload under ``least_bytes``
is always a response; line breaks in a url are percent-encoded; an empty table gives an
archive of the warcinfo record alone, read as no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bloom import may_hold
from ._common import cut, fresh_path, table

_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: Records of one file at most; with pages of some 100 kB a file stays under 100 MB.
FILE_RECORDS = 3000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: 5 hex digits make 4 base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _record(kind: str, headers: list[Column], block: Column) -> Column:
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n"), *headers)
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def _held(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows(page_id, url, html)`` with ``revisit``, ``first`` (the largest page_id
    with an equal payload) and ``held`` (the identifier of its record, null where no other
    row has the payload), and ``u``, which tells rows of one page_id and payload apart."""
    # Filters are moved down to the scan, where nothing that they compute is kept: each mention of
    # SHA-1 in one would be computed anew.  So rows are told apart there by a quick hash.
    sha, quick, enough = F.sha1(F.col("html").cast("binary")), F.xxhash64("html"), F.octet_length("html") >= least_bytes
    slim = rows.where(enough).groupBy(sha.alias("shared"), quick.alias("quick"), "page_id").agg(F.count("*").alias("k"))
    shared = slim.groupBy("shared", "quick").agg(F.max(F.struct("page_id", "k")).alias("first"), F.sum("k").alias("many")).where("many > 1")
    shared = cut(shared.select("shared", "quick", F.col("first.page_id").alias("first"), F.col("first.k").alias("ties")))
    none = {"revisit": F.lit(False), "first": F.lit(None).cast("long"), "held": F.lit(None).cast("string"), "u": F.lit(None).cast("long")}
    if shared.isEmpty():
        return rows.withColumns(none)
    maybe = may_hold(shared.select(F.col("quick").alias("key")), quick)
    some = rows.where(maybe).withColumn("sha", sha).join(shared.drop("quick"), (F.col("sha") == F.col("shared")) & enough, "left")
    has, own = F.col("shared").isNotNull(), F.col("page_id").eqNullSafe(F.col("first"))
    some = some.withColumns({"revisit": has & ~own, "held": F.when(has, _ident(F.lit("held"), F.col("shared"))), "tied": F.coalesce(has & own & (F.col("ties") > 1), F.lit(False))})
    columns = rows.columns
    numbered = lambda d, which: d.select(*columns, "revisit", "first", "held", F.when(which, F.monotonically_increasing_id()).alias("u"))
    out = rows.where(~maybe).withColumns(none).unionByName(numbered(some.where(~F.col("tied")), F.col("revisit")))
    if not shared.where("ties > 1").isEmpty():
        # One of the rows that repeat the largest page_id is the one that revisits refer to.
        ties = cut(numbered(some.where("tied"), F.lit(True)))
        one = cut(ties.groupBy(F.col("held").alias("of")).agg(F.min("u").alias("one")))
        out = out.unionByName(ties.join(one, F.col("held") == F.col("of")).withColumn("u", F.when(F.col("u") != F.col("one"), F.col("u"))).drop("of", "one"))
    return out


def _ident(*parts: Column) -> Column:
    return F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("|", *parts), 256), F.lit(">"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, compression: str = "none") -> None:
    """Write the archives of ``pages`` below ``path``."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = _held(rows, least_bytes).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    # The row that others refer to, if any, has that identifier; of all others page, payload and ``u`` make one.
    own = F.when(F.col("held").isNotNull() & F.col("u").isNull(), F.col("held")).otherwise(_ident(F.lit("capture"), F.col("page_id").cast("string"), F.col("digest"), F.md5(F.coalesce("url", F.lit(""))), F.coalesce(F.col("u").cast("string"), F.lit("-"))))
    if least_bytes > 0:  # short payloads may repeat in full, so they are numbered as well
        rows = rows.withColumn("u", F.when(F.col("held").isNull(), F.monotonically_increasing_id()).otherwise(F.col("u")))
    rows = rows.withColumns({"uri": _line("WARC-Target-URI", F.col("url")), "own": own})
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    head = [_line("WARC-Record-ID", F.col("own")), F.col("uri"), F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    refers = [_line("WARC-Refers-To", F.col("held")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")]
    capture = F.when(F.col("revisit"), _record("revisit", [*head, *refers], http)).otherwise(_record("response", head, http))
    also = lambda kind: [_line("WARC-Record-ID", _ident(F.lit(kind), F.col("own"))), F.col("uri"), _line("WARC-Concurrent-To", F.col("own"))]
    request = _record("request", [*also("request"), F.lit("Content-Type: application/http; msgtype=request\r\n")], F.concat(F.lit("GET "), F.coalesce("url", F.lit("")), F.lit(" HTTP/1.1\r\n\r\n")))
    fields = F.concat(_line("page-id", F.col("page_id").cast("string")), _line("payload-length", F.octet_length("html").cast("string")))
    metadata = _record("metadata", [*also("metadata"), F.lit("Content-Type: application/warc-fields\r\n")], fields)
    about = [_line("WARC-Record-ID", _ident(F.lit("warcinfo"), F.lit(path))), F.lit("Content-Type: application/warc-fields\r\n")]
    first = pages.sparkSession.range(0, 1, 1, 1).select(_record("warcinfo", about, F.lit("software: cityloom\r\nformat: WARC File Format 1.1\r\n")).alias("value"))
    first.unionByName(rows.select(F.explode(F.array(capture, request, metadata)).alias("value"))).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    view, at, find = memoryview(data), 0, re.compile(rb"\r\n\r\n")
    while at < len(view):
        end = find.search(view, at).start()
        lines = bytes(view[at:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, view[end + 4 : end + 4 + size]
        at = end + 8 + size


def _inflated(raw: pa.Buffer) -> bytes:
    """All members of a gzip file."""
    out, left = [], raw.to_pybytes()
    while left:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(left))
        left = member.unused_data
    return b"".join(out)


_SCHEMA = "kind string, id string, concurrent_to string, refers_to string, url string, digest string, checked boolean, page_id long, payload_bytes long, payload binary"


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            raw = content.as_buffer()
            data = _inflated(raw) if len(raw) > 1 and raw[:2].to_pybytes() == b"\x1f\x8b" else raw
            for head, block in parse(data):
                kind, get = head["warc-type"], head.get
                if kind == "warcinfo":
                    continue
                page = size = payload = checked = None
                digest = get("warc-payload-digest", "").removeprefix("sha1:") or None
                if kind == "response":
                    body = block[bytes(block[:400]).index(b"\r\n\r\n") + 4 :]
                    size = len(body)
                    actual = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    checked, digest = actual == digest, actual
                    payload = bytes(body) if payloads else None
                    held += size if payloads else 0
                elif kind == "metadata":
                    fields = dict(x.split(": ", 1) for x in bytes(block).decode().split("\r\n") if ": " in x)
                    page = int(fields["page-id"]) if "page-id" in fields else None
                    size = int(fields["payload-length"])
                rows.append((kind, get("warc-record-id"), get("warc-concurrent-to"), get("warc-refers-to"), get("warc-target-uri"), digest, checked, page, size, payload))
                if len(rows) >= 10_000 or held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives below ``path``, those about the archive left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(partial(_records, payloads=payloads), _SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: page_id, record_type, payload_bytes, payload_digest,
    refers_to (a page_id), and the structs ``capture``, ``request`` and ``metadata``."""
    seen = F.col("kind").isin("response", "revisit")
    capture = records.where(seen).withColumnRenamed("id", "own")
    side = lambda kind, *cols: records.where(F.col("kind") == kind).dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias("own"), F.struct("id", *cols).alias(kind))
    rows = capture.join(side("request", "url"), "own", "left").join(side("metadata", "page_id", "payload_bytes"), "own", "left")
    # Only revisits look up what they refer to: by the metadata that is concurrent to that record.
    held = side("metadata", "page_id").select(F.col("own").alias("refers_to"), F.col("metadata.page_id").alias("refers"))
    alone = rows.where("refers_to is null").withColumn("refers", F.lit(None).cast("long"))
    rows = alone.unionByName(rows.where("refers_to is not null").join(held, "refers_to", "left").select(*alone.columns))
    return rows.select(F.col("metadata.page_id").alias("page_id"), F.coalesce(F.col("payload_bytes"), F.col("metadata.payload_bytes")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"), F.struct("own", "url", "digest", "checked", "payload").alias("capture"), "request", "metadata")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return assemble(read(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _quad(i: int) -> str:
    v = f"('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT"
    return " || ".join(f"substr('{_BASE32}', ((({v}) >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))


OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {" || ".join(_quad(i) for i in range(8))} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
