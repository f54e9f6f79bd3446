"""WARC archives: writing with revisits, chunked framing and segments, and reading back with reassembly."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hot_from, materialize, new_path

END = b"\r\n\r\n"
#: Payloads from this size on are stored once; bytes of a record's block before it is segmented; bytes of a chunk.
LEAST_REVISIT, SEGMENT_BYTES, CHUNK_BYTES = 100, 16 * 1024, 4 * 1024
#: Records of an archive file, so that a file is 32 MB at most before compression.
FILE_RECORDS = 2000
CHUNK_SIZE, WHOLE = re.compile(rb"[0-9a-fA-F]{1,12}"), re.compile(r"-?[0-9]+")
PAGE_URN = re.compile(r"<urn:page:(-?\d*)")
RECORD = "record_id string, type string, page_id long, url string, refers_to long, digest string, segment int, origin string, total long, block binary, problem string"
PAYLOAD = "page_id long, url string, record_type string, refers_to long, digest string, stated_bytes long, payload binary, problem string"
READ = PAYLOAD + ", segment int, origin string, record_id string, total long"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """What chunked framing holds; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        digits = framed[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not CHUNK_SIZE.fullmatch(digits):
            raise ValueError("the size of a chunk is missing or wrong")
        size = int(digits, 16)
        if size == 0:
            return b"".join(out)
        if len(framed) < end + 4 + size:
            raise ValueError("a chunk is cut off")
        if framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk doesn't end where it says")
        out.append(framed[end + 2 : end + 2 + size])
        at = end + 4 + size


def whole_number(x: str | None, bits: int = 64) -> int | None:
    """A whole number of so many bits, sign included; nothing gives None, anything else is an error."""
    if not x:
        return None
    if not WHOLE.fullmatch(x) or len(x) > 25 or not -(1 << bits - 1) <= int(x) < 1 << bits - 1:
        raise ValueError("not a whole number in range")
    return int(x)


def archive_records(kind: str, head: str, record_id: str, payload: str | None, n_bytes: int) -> list[bytes]:
    """One record, or its segments if the block is large; each without the blank line that ends it."""
    if kind == "revisit":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked((payload or "").encode("utf-8", "surrogatepass"))
    first = head.encode("utf-8", "surrogatepass")
    if len(block) <= SEGMENT_BYTES:
        return [first + b"Content-Length: %d\r\n\r\n" % len(block) + block]
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    out = [first + b"WARC-Segment-Number: 1\r\nContent-Length: %d\r\n\r\n" % len(parts[0]) + parts[0]]
    for k, part in enumerate(parts[1:], 2):
        own = f"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: {record_id[:-1]}:{k}>\r\nWARC-Segment-Origin-ID: {record_id}\r\nWARC-Segment-Number: {k}\r\n"
        own += f"WARC-Segment-Total-Length: {len(block)}\r\n" if k == len(parts) else ""
        out.append(own.encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(part) + part)
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record for every page; the payload is the html in UTF-8 (null: empty).

    Of records with equal payloads of LEAST_REVISIT bytes or more, that with the smallest page id is the response
    and the others are revisits of it; rows that share that id and payload are all responses, and so are rows of a
    group without any id. Line ends in addresses are percent-encoded. An empty table writes an archive without
    records. Spark's text writer writes the files (whole files compressed), to any store that it reaches.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.replace(F.replace(F.coalesce(F.col(url_col), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    groups = rows.where(F.col("n_bytes") >= LEAST_REVISIT).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1 and first is not null"), "payloads")
    # payloads that very many pages share meet them by broadcast: 10,000 of them at most
    often = hot_from(groups.agg(F.sum("n")).first()[0] or 0)
    broad = F.broadcast(groups.where(F.col("n") > often).select(F.col("of").alias("digest"), F.col("first").alias("hot")))
    rows = rows.join(broad, "digest", "left")
    calm = groups.where(F.col("n") <= often).select("of", "first")
    own = F.concat_ws(":", "digest", F.coalesce("page_id", F.lit(0)))  # of rows that need no partner, so that they spread
    rows = rows.withColumn("sought", F.when(F.col("hot").isNull() & (F.col("n_bytes") >= LEAST_REVISIT), F.col("digest")).otherwise(own))
    rows = rows.join(calm, F.col("sought") == F.col("of"), "left").withColumn("first", F.coalesce("hot", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.expr("uuid()"), F.lit(">"))
    rows = rows.select("*", F.when(revisit, "revisit").otherwise("response").alias("kind"), urn.alias("record_id"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("kind"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">\r\n"))).otherwise(""),
    )

    @F.pandas_udf("array<binary>")
    def framed(kind: pd.Series, head: pd.Series, record_id: pd.Series, html: pd.Series, n_bytes: pd.Series) -> pd.Series:
        return pd.Series([archive_records(*x) for x in zip(kind, head, record_id, html, n_bytes, strict=True)], dtype=object)

    payload = F.when(~revisit, F.col("html"))
    records = rows.select(F.explode(framed(F.col("kind"), head, F.col("record_id"), payload, F.col("n_bytes"))).alias("record"))
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflated(data: bytes) -> tuple[bytes, str | None]:
    """The content of a gzip file of one or more members, as far as it can be read, and what is wrong with it."""
    parts = []
    while data:
        unzip = zlib.decompressobj(31)
        try:
            for k in range(0, len(data), 1 << 20):
                parts.append(unzip.decompress(data[k : k + (1 << 20)]))
                if unzip.eof:
                    data = unzip.unused_data + data[k + (1 << 20) :]
                    break
            else:
                return b"".join(parts), "the archive is cut off"
        except zlib.error:
            return b"".join(parts), "the archive is damaged"
    return b"".join(parts), None


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The records of an archive file, in order, as rows of RECORD. What can't be read is a row with its problem."""
    damage = None
    if data[:2] == b"\x1f\x8b":
        data, damage = inflated(data)
    at = data.find(b"WARC/1.")
    while at >= 0:
        end = data.find(END, at)
        if end < 0:
            damage = damage or "the header of a record is cut off"
            break
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        start, record_id = end + len(END), fields.get("warc-record-id")
        page, other = PAGE_URN.match(record_id or ""), PAGE_URN.match(fields.get("warc-refers-to", ""))
        try:
            kind, size, total = fields["warc-type"], whole_number(fields["content-length"]), whole_number(fields.get("warc-segment-total-length"))
            page_id, refers_to, segment = whole_number(page and page[1]), whole_number(other and other[1]), whole_number(fields.get("warc-segment-number"), 32)
            if size is None or size < 0:
                raise ValueError
        except (KeyError, ValueError):
            yield record_id, fields.get("warc-type"), None, fields.get("warc-target-uri"), None, None, None, None, None, b"", "the header of the record is incomplete or wrong"
            found = data.find(END + b"WARC/1.", end)
            at = found + len(END) if found >= 0 else -1
            continue
        block = data[start : start + size]
        yield record_id, kind, page_id, fields.get("warc-target-uri"), refers_to, fields.get("warc-payload-digest"), segment, fields.get("warc-segment-origin-id"), total, block, None if len(block) == size else "the record is cut off"
        at = data.find(b"WARC/1.", start + size)
    if damage:
        yield None, None, None, None, None, None, None, None, None, b"", damage


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    whole = {x.split()[0] for x in schema.split(", ") if x.split()[1] in ("int", "long")}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pd.DataFrame({n: pd.Series(list(c), dtype="Int64" if n in whole else object) for n, c in zip(names, columns, strict=True)})


def payload_row(page_id, url, kind, refers_to, digest, block: bytes, problem: str | None = None) -> tuple:
    """A row of PAYLOAD from a whole record."""
    stated, payload = None, None
    if not problem and kind == "revisit" and refers_to is None:
        problem = "a revisit names no page"
    if not problem:
        head, _, body = block.partition(END)
        try:
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        except ValueError as e:
            problem = str(e)
        if found := re.search(rb"content-length:\s*(\d{1,18})(?!\d)", head, re.I):
            stated = int(found[1])
        if payload is not None and kind == "response" and digest and digest != "sha256:" + hashlib.sha256(payload).hexdigest():
            problem = "the payload is not that of its digest"
    return page_id, url, kind, refers_to, digest, stated, None if kind == "revisit" else payload, problem


def reassemble(segments: pd.DataFrame) -> pd.DataFrame:
    """One record from the segments of one origin: in order of their numbers, gapless, of the stated total length."""
    segments = segments.sort_values("segment")
    first = segments.iloc[0]
    none = lambda x: None if pd.isna(x) else x
    block = b"".join(segments["block"])
    total = segments["total"].dropna()
    problem = None
    if segments["problem"].notna().any():
        problem = segments["problem"].dropna().iloc[0]
    elif list(segments["segment"]) != list(range(1, len(segments) + 1)):
        problem = "segments are missing or repeated"
    elif len(total) != 1 or int(total.iloc[0]) != len(block):
        problem = "the total length is not that of the segments"
    return _frame([payload_row(none(first["page_id"]), first["url"], first["type"], none(first["refers_to"]), first["digest"], block, problem)], PAYLOAD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """PAYLOAD of every record below path; continuation records are joined to their origin.

    A record whose segments are incomplete, whose lengths or framing are wrong or whose payload isn't that of its
    digest keeps its row, and `problem` says what is wrong (else null). So does a header without type or length, or
    with a number that is none; the records behind it are read. An archive that is cut off or damaged gives what can
    be read of it and a row with the problem alone. Records of equal ids are parts of one. An archive without records
    gives an empty table.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows: list[tuple] = []
                for record_id, kind, page_id, url, refers_to, digest, segment, origin, total, block, problem in parse_archive(content):
                    if segment is None:  # a whole record, decoded at once
                        rows.append((*payload_row(page_id, url, kind, refers_to, digest, block, problem), None, None, None, None))
                    else:
                        rows.append((page_id, url, kind, refers_to, digest, None, block, problem, segment, origin, record_id, total))
                    if len(rows) == 500:
                        yield _frame(rows, READ)
                        rows = []
                yield _frame(rows, READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    found = files.mapInPandas(parse, READ).withColumn("teil", F.col("segment").isNotNull())
    # read once: whole records and segments are written apart, and only segments are shuffled
    kept = new_path(spark, "records")
    found.write.partitionBy("teil").parquet(kept)
    records = spark.read.schema(found.schema).parquet(kept)
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    parts = records.where("teil").withColumn("of", F.coalesce("origin", "record_id")).withColumnsRenamed({"record_type": "type", "payload": "block"})
    return records.where("not teil").select(*names).unionByName(parts.groupBy("of").applyInPandas(reassemble, PAYLOAD))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    return read_archives(pages.sparkSession, path)
