"""WARC archives with revisit records.

``write_archive`` lays records out with Spark's text writer: a row is one whole record, and
the line separator is the record separator (two CRLF), so every part file is a WARC file
in a folder that all executors reach. ``read_archive`` takes records apart by their
Content-Length. ``resolve_revisits`` shuffles headers only: by payload digest the largest id
is kept with a map-side combined maximum, so a digest that holds a third of all pages stays
cheap, and revisits are joined back to it.
"""

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.session import shared_folder

REVISIT_FROM_BYTES = 1000
RECORDS_PER_FILE = 2000
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers_of(pages: DataFrame, *, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """Id, length and digest of every payload (null: empty)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return pages.select(F.col(page_id).alias("page_id"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))


def resolve_revisits(headers: DataFrame, *, least_bytes: int = REVISIT_FROM_BYTES) -> DataFrame:
    """For each payload held by more than one id: payload_digest, original (the largest id).

    Payloads under ``least_bytes`` are never revisited. A null id is no original.
    """
    return (
        headers.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("original").isNotNull())
        .select("payload_digest", "original")
    )


def _record_id(page_id: Column) -> Column:
    """A stable urn:uuid from the id, so that a rerun writes the same record."""
    h = F.sha1(F.concat(F.lit("billweave/warc/"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))


def _header_text(value: Column) -> Column:
    """One line: control characters would end the header, so they are percent-encoded away."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = REVISIT_FROM_BYTES) -> None:
    """Write every page as a record: responses with their payload, revisits with fresh headers and none.

    Repeated rows with one id and payload all count as that id: the response is written for
    each row that has the original's id.
    """
    headers = headers_of(pages, page_id=page_id, payload=payload)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url") if url in pages.columns else F.lit(None).cast("string").alias("url"),
        body.alias("payload"),
        F.octet_length(body.cast("binary")).cast("long").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
    )
    originals = resolve_revisits(headers, least_bytes=least_bytes).hint("shuffle_hash")
    small = rows.where(F.col("payload_bytes") < least_bytes).withColumn("original", F.lit(None).cast(rows.schema["page_id"].dataType))
    large = rows.where(F.col("payload_bytes") >= least_bytes).join(originals, "payload_digest", "left").select(*small.columns)
    joined = small.unionByName(large)
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header_text(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("original"))), line("X-Refers-To-Page", F.col("original").cast("string")), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = joined.select(F.concat(header, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))
    record.write.mode("errorifexists").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
RECORDS = "record_type string, page_id long, url string, record_id string, payload_digest string, payload_bytes long, refers_to long, refers_to_record string, payload string"


def records_in(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of every record of one file; a damaged file is an error."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head_end = data.index(b"\r\n\r\n", at) + 2
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data, data.index(b"\r\n", at) + 2, head_end)}
        start = head_end + 2
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, payload included (null for revisits); files are bounded by ``RECORDS_PER_FILE``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                if name.endswith(".gz"):
                    data = zlib.decompress(data, wbits=47)
                columns: list[list] = [[] for _ in range(9)]
                for f, block in records_in(data):
                    revisit = f["warc-type"] == "revisit"
                    number = lambda x: None if x in (None, "null") else int(x)
                    row = (
                        f["warc-type"], number(f["x-page-id"]), f["warc-target-uri"], f["warc-record-id"], f["warc-payload-digest"].removeprefix("sha1:"),
                        int(f["x-payload-length"]), number(f.get("x-refers-to-page")), f.get("warc-refers-to"), None if revisit else block.decode(),
                    )
                    for column, value in zip(columns, row):
                        column.append(value)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = [c.split()[0] for c in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(parse, RECORDS)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write the deduplicated archives of the pages and read them back: one row per record.

    Null payload: an empty one. Empty table: no rows. Ids are integers or null. Extra
    columns stay out of the archive.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, **options)
    return read_archive(spark, path)
