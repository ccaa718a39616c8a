"""Writes captures as WARC archives and assembles them again from the records.

Each capture is three records: the request, the response (or a revisit, where
another capture holds the same payload) and metadata.  Request and metadata
name the response in WARC-Concurrent-To; that is how they are joined on
reading.  Records are text that ends in an empty line, so Spark's text writer
with that end as its line separator writes archives to any file system, and a
lost task is written again.  Payloads move through one exchange, before which
equal ones are merged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsmill.llm.frames import importable

# Fixed values of the format.
VERSION, LINE, GAP = "WARC/1.1", "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)
#: Repeated captures are multiplied in two steps of at most so many rows each.
STEP = 10_000


def _name(role: str, page: Column) -> Column:
    """The identifier of a capture's record: the same whenever a task runs again."""
    given = [F.coalesce(page[c].cast("string"), F.lit("-")) for c in ("page_id", "url", "digest", "copy")]
    hexes = F.md5(F.concat_ws("|", F.lit(role), *given))
    parts = [F.substr(hexes, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _captures(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page, keeper, payload_bytes, html): html only where the capture stores it, else keeper has the one that does."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.translate(F.col(url_col).cast("string"), LINE, "").alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("digest"),
    )
    # Null ids last, and the first of repeated rows, which the copy numbers tell apart.
    order = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "url")
    payloads = own.groupBy("digest").agg(F.first("html").alias("html"), F.min(order).alias("keeper"))
    counted = own.groupBy("page_id", "url", "digest").agg(F.count("*").alias("times"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(STEP).cast("long"))
    joined = counted.withColumn("start", F.explode(starts)).join(payloads, "digest")
    copies = F.sequence("start", F.least(F.col("start") + STEP, F.col("times")) - 1)
    each = joined.select("page_id", "url", "digest", "html", "keeper", F.explode(copies).alias("copy"))
    page = F.struct("page_id", "url", "digest", "copy")
    keeper = F.struct(
        F.col("keeper.page_id").alias("page_id"),
        F.col("keeper.url").alias("url"),
        F.col("digest"),
        F.lit(0).cast("long").alias("copy"),
    )
    size = F.octet_length("html").cast("long")
    stores = (size < least) | page.eqNullSafe(keeper)
    return each.select(
        page.alias("page"), keeper.alias("keeper"), size.alias("payload_bytes"), F.when(stores, F.col("html")).alias("html")
    )


def _record(kind: Column, block: Column, mime: str, **headers: Column) -> Column:
    """One record without the empty line at its end.  A header that is null is left out."""
    lines = [F.concat(F.lit(f"{k.replace('_', '-')}: "), v) for k, v in headers.items()]
    return F.concat(
        F.lit(f"{VERSION}{LINE}WARC-Type: "),
        kind,
        F.lit(LINE),
        F.concat_ws(LINE, *lines),
        F.lit(f"{LINE}Content-Type: {mime}{LINE}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(GAP),
        block,
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    least: int = 100,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    captures_per_file: int = 50_000,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Writes gzipped archives of all pages.

    Of equal payloads of `least` bytes or more, the capture with the smallest
    id stores it and the others revisit it; shorter ones are always stored.
    Null payloads count as empty, null ids come last and have no page-id field,
    null addresses no target; line breaks in addresses are dropped; repeated
    rows are captures of their own.  Other columns are ignored.
    """
    page, keeper = F.col("page"), F.col("keeper")
    answer, url = _name("response", page), page["url"]
    stores = F.col("html").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(GAP),
        F.coalesce("html", F.lit("")),
    )
    response = _record(
        F.when(stores, F.lit("response")).otherwise(F.lit("revisit")),
        http,
        "application/http; msgtype=response",
        WARC_Record_ID=answer,
        WARC_Date=F.lit(date),
        WARC_Target_URI=url,
        WARC_Payload_Digest=F.concat(F.lit("sha256:"), page["digest"]),
        WARC_Refers_To=F.when(~stores, _name("response", keeper)),
        WARC_Profile=F.when(~stores, F.lit(REVISIT_PROFILE)),
    )
    beside = {"WARC_Date": F.lit(date), "WARC_Target_URI": url, "WARC_Concurrent_To": answer}
    request = _record(
        F.lit("request"),
        F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{GAP}")),
        "application/http; msgtype=request",
        WARC_Record_ID=_name("request", page),
        **beside,
    )
    fields = F.concat_ws(
        "",
        F.concat(F.lit("page-id: "), page["page_id"].cast("string"), F.lit(LINE)),
        F.lit(f"charset: utf-8{LINE}"),
    )
    metadata = _record(
        F.lit("metadata"), fields, "application/warc-fields", WARC_Record_ID=_name("metadata", page), **beside
    )
    kept = _captures(pages, id_col, url_col, html_col, least)
    records = kept.select(F.explode(F.array(request, response, metadata)).alias("value"))
    options = {"lineSep": GAP, "compression": "gzip", "maxRecordsPerFile": str(3 * captures_per_file)}
    records.write.options(**options).text(folder)


class _Stream:
    """Bytes of a gzipped or plain archive, decompressed as they are needed."""

    def __init__(self, content: bytes, step: int = 1 << 20):
        self.content, self.at, self.step = memoryview(content), 0, step
        self.packed = content[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(47) if self.packed else None
        self.buffer = bytearray()

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        chunk = bytes(self.content[self.at : self.at + self.step])
        self.at += len(chunk)
        while chunk and self.inflate is not None:
            self.buffer += self.inflate.decompress(chunk)
            chunk = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(47)
        self.buffer += chunk
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark; none at the end of the archive."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record")
                return None
        head = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return head

    def take(self, count: int) -> bytes:
        while len(self.buffer) < count:
            if not self._more():
                raise ValueError("the archive ends within a record")
        block = bytes(self.buffer[:count])
        del self.buffer[:count]
        return block


def _named(lines: str) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.split(LINE) if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse(content: bytes, keep_payload: bool) -> Iterator[dict]:
    """The records of one archive as rows of RECORDS."""
    stream = _Stream(content)
    while (head := stream.until(GAP.encode())) is not None:
        headers = _named(head.decode())
        block = stream.take(int(headers["content-length"]))
        stream.take(len(GAP))
        kind = headers["warc-type"]
        row = {
            "record_id": headers["warc-record-id"],
            "record_type": kind,
            "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"),
            "target_uri": headers.get("warc-target-uri"),
        }
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(GAP.encode())
            row["payload_digest"] = headers["warc-payload-digest"].removeprefix("sha256:")
            row["payload_bytes"] = int(_named(http.decode())["content-length"])
            if kind == "response":
                row["payload_bytes"] = len(payload)
                row["payload_digest"] = hashlib.sha256(payload).hexdigest()
                row["payload"] = payload if keep_payload else None
        elif kind == "metadata":
            row["fields"] = list(_named(block.decode()).items())
        yield row


def read_records(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """All records of the archives in a folder; sizes and digests of responses are taken from their payloads."""
    importable(spark)
    schema = pa.schema(
        [(c, pa.string()) for c in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri")]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        + [("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for row in parse(content.as_py(), keep_payload):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 2_000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, with its requests and metadata.

    Records are joined by concurrent-to; captures without such records get
    empty lists, records that name no known capture give no row.
    """
    request = F.when(F.col("record_type") == "request", F.struct("record_id", "target_uri"))
    metadata = F.when(F.col("record_type") == "metadata", F.struct("record_id", "fields"))
    beside = records.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    beside = beside.groupBy(F.col("concurrent_to").alias("capture")).agg(
        F.collect_list(request).alias("requests"), F.collect_list(metadata).alias("metadata")
    )
    main = records.where(F.col("record_type").isin("response", "revisit"))
    main = main.drop("concurrent_to", "fields")
    joined = main.join(beside, F.col("record_id") == F.col("capture"), "left").drop("capture")
    return joined.withColumns({c: F.coalesce(c, F.array()) for c in ("requests", "metadata")})


def page_ids(captures: DataFrame) -> DataFrame:
    """The page of each capture and, for revisits, the page of the capture they refer to."""
    number = F.try_element_at("metadata", F.lit(1))["fields"]["page-id"].cast("long")
    named = captures.withColumn("page_id", number)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    response = named.where(F.col("record_type") == "response")
    stores = response.select(F.col("record_id").alias("_stored"), F.col("page_id").alias("_of"))
    # Only revisits take part in the join: the others' nulls would meet in one task.
    revisits = named.where(F.col("record_type") == "revisit").join(stores, F.col("refers_to") == F.col("_stored"), "left")
    return response.select(*columns, F.lit(None).cast("long").alias("refers_to"), "target_uri").unionAll(
        revisits.select(*columns, F.col("_of").alias("refers_to"), "target_uri")
    )
