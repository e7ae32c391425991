"""WARC archives with repeated payloads written once.

Headers alone are shuffled by payload digest to find the first page of each payload. Pages are then joined
to that table, revisit records are written without their payload, and every record gets fresh headers.
Archives are read back record by record, and revisits are resolved against the responses they refer to.
"""

import base64
import gzip
import hashlib
import io
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.session import checkpointed, ensure_checkpoint_dir

#: Payloads with fewer bytes are always written in full.
MIN_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32, by 20 bits (five hexadecimal digits, four letters) at a time."""
    digits = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """The same row always gets the same id, also when a task runs again."""
    h = F.md5(F.to_json(F.struct(page_id.alias("p"), url.alias("u"), digest.alias("d"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or null (left out) for a null value. Line ends inside a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), safe)


def _key_field(name: str, value: Column) -> Column:
    """As ``_field``, but lossless: percent signs are encoded as well, so that every ``%XX`` can be decoded again."""
    return _field(name, F.replace(value.cast("string"), F.lit("%"), F.lit("%25")))


def resolved(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages with their digest and the first page of equal payload (``first``, null for responses).

    The first page is the one with the smallest ``page_id``, then the smallest ``url``; null ids come last.
    Rows that equal it in both are responses as well. Null payloads are empty payloads.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    pages = pages.withColumn("digest", payload_digest(F.col("payload")))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    first = checkpointed(pages.select("digest", place.alias("place"), F.octet_length("payload").alias("n_bytes"))
                         .where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("place").alias("first")))
    joined = pages.join(first, "digest", "left")
    original = F.col("first").isNull() | F.col("first").eqNullSafe(place)
    return joined.select("page_id", "url", "payload", "digest", F.when(~original, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, date: Column | None = None,
                   records_per_file: int = 20_000) -> None:
    """Write ``pages (page_id, url, html)`` as gzipped WARC/1.1 files.

    An archive holds what one shuffle partition holds, at most ``records_per_file`` records. ``date`` is the
    ``WARC-Date`` (default: now). Page ids of any text come back as they were; line ends in a URL stay encoded.
    """
    rows = resolved(pages, min_bytes)
    date = date if date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    is_revisit = F.col("first").isNotNull()
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    size.cast("string"), F.lit(_END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        _field("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        _field("WARC-Date", date), _field("WARC-Target-URI", F.col("url")), _key_field("Page-ID", F.col("page_id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Profile", F.when(is_revisit, PROFILE)),
        _field("WARC-Refers-To", F.when(is_revisit, _record_id(F.col("first.page_id"), F.col("first.url"),
                                                               F.col("digest")))),
        _field("WARC-Refers-To-Target-URI", F.when(is_revisit, F.col("first.url"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        _field("Content-Length", F.octet_length(block)))
    (rows.select(F.concat(lines, F.lit(_END), block).alias("value"))
     .write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
     .text(folder))


def _records(stream):
    """Header dict and block of each record of an archive."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().removesuffix("\n").removesuffix("\r").partition(":")
            name = name.strip().lower()
            # Blanks belong to a key, but for the one after the colon.
            head[name] = unquote(value.removeprefix(" ")) if name == "page-id" else value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("archive ends inside a record")
        yield head, block


NAMES = ["record_id", "record_type", "page_id", "url", "digest", "refers_to", "payload_bytes", "payload"]
RECORDS = ("record_id string, record_type string, page_id string, url string, digest string, refers_to string, "
           "payload_bytes long, payload binary")


def _read(with_payload, batch_bytes=1 << 23):
    types = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], NAMES)

    def rows(batches):
        out, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for head, block in _records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    length = None
                    if head["warc-type"] == "response":
                        length = len(payload)
                        if digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    out.append((head["warc-record-id"], head["warc-type"], head.get("page-id"),
                                head.get("warc-target-uri"), digest, head.get("warc-refers-to"), length,
                                payload if with_payload else None))
                    size += 200 + len(payload) * with_payload
                    if size > batch_bytes:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    return rows


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record. Archives are streamed, so a task holds one compressed file and one record."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_read(with_payload), RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the page and the size of the response it refers to.

    Headers only. A revisit whose response is in none of the archives keeps nulls.
    """
    heads = checkpointed(records.select("record_id", "record_type", "page_id", "url", "digest", "refers_to",
                                        "payload_bytes"))
    responses = checkpointed(heads.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.min("page_id").alias("first_page"), F.max("payload_bytes").alias("first_bytes")))
    full = heads.where("record_type <> 'revisit'").select(
        "page_id", "url", "payload_bytes", "digest", "record_type", F.lit(None).cast("string").alias("refers_to"))
    again = heads.where("record_type = 'revisit'").join(responses, "refers_to", "left").select(
        "page_id", "url", F.col("first_bytes").alias("payload_bytes"), "digest", "record_type",
        F.col("first_page").alias("refers_to"))
    return full.union(again)


def archive_report(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives to the shared folder, read them back, and tell what each page became.

    Any row of ``pages`` gives a row; other columns than ``page_id``, ``url`` and ``html`` are not read.
    An empty table writes an archive without records and gives no rows.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    kind = pages.schema["page_id"].dataType
    write_archives(pages, folder, min_bytes)
    found = resolve_revisits(read_archives(spark, folder, with_payload=False))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes",
                        F.col("digest").alias("payload_digest"), "record_type",
                        F.col("refers_to").cast(kind).alias("refers_to"))
