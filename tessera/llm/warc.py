"""A content-addressed web archive: payloads once by SHA-256, exact headers apart, WARC files in between."""

from __future__ import annotations

import gzip
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize, shared_dir

END = "\r\n"
#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "warc_type string, record_id string, refers_to string, target_uri string, page_id string, payload_digest string, header binary, http_header binary, payload binary"
#: Bytes of records that go from a reading task to Spark at once (one record at least).
READ_BYTES = 8 << 20


def record_id(page_id: Column, digest: Column) -> Column:
    """A urn:uuid that depends on page and payload alone."""
    hashed = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hashed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def store(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> None:
    """Write ``path``/payloads (digest, payload: each once) and ``path``/headers (page_id, digest,
    warc_type, header, http_header: the exact lines of each record).

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest id is the
    response (a null id only if no other is left) and the rest revisit it. Null html: an empty
    payload. Null url: no target line; line ends in a url are percent-encoded. Rows equal in id and
    payload are responses, or revisits, alike. Other columns are not read.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    # equal payloads are one before they are shuffled, so a very frequent one is no burden
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    once.select("digest", F.col("payload").cast("binary").alias("payload")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")

    revisit = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("warc_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), record_id(F.col("first"), F.col("digest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length("http_header") + 4 + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
    ]
    headers = rows.drop("payload").join(first, "digest").withColumn("warc_type", F.when(revisit, "revisit").otherwise("response")).withColumn("http_header", http)
    headers.select("page_id", "digest", "warc_type", F.concat_ws(END, *lines).alias("header"), "http_header").write.mode("overwrite").parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, warc_type, record): the records of a store, each put together from its header and,
    for a response, the payload that its digest names. A payload that doesn't match its digest is an error."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))).cast("binary"))
    gap = F.lit(END + END)
    revisits = headers.where("warc_type = 'revisit'").select("page_id", "warc_type", F.concat("header", gap, "http_header", gap).cast("binary").alias("record"))
    responses = headers.where("warc_type = 'response'").join(payloads, "digest")
    return responses.select("page_id", "warc_type", F.concat(F.concat("header", gap, "http_header", gap).cast("binary"), sound).alias("record")).unionByName(revisits)


def write_files(found: DataFrame, path: str) -> None:
    """Write records as compressed WARC files; every record ends in two line ends."""
    found.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", END + END).option("compression", "gzip").text(path)


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.MULTILINE)


def parsed(data: bytes):
    """The records of one WARC file, by their stated lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        header = data[at:stop]
        fields = {k.lower(): v.strip() for k, v in _FIELD.findall(header)}
        block = data[stop + 4 : stop + 4 + int(fields[b"content-length"])]
        at = stop + 4 + len(block) + 4
        http, _, payload = block.partition(b"\r\n\r\n") if fields.get(b"content-type", b"").startswith(b"application/http") else (b"", b"", block)
        text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
        yield text.get(b"warc-type"), text.get(b"warc-record-id"), text.get(b"warc-refers-to"), text.get(b"warc-target-uri"), text.get(b"x-page-id"), text.get(b"warc-payload-digest"), header, http, payload


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in a folder, compressed or not; a file is read by one task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # a partition holds so many bytes of files as one of any scan
    names, kinds = zip(*(x.split() for x in RECORD.split(", ")), strict=True)
    schema = pa.schema([(n, pa.large_binary() if k == "binary" else pa.large_string()) for n, k in zip(names, kinds, strict=True)])

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows, size = [], 0
                for record in parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append(record)
                    size += len(record[-1]) + 500
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that were read: a
    revisit takes size and digest from the response it refers to. Digests are computed from the
    payloads; one that differs from its record's header is an error."""
    digest = F.sha2("payload", 256)
    sound = F.when(F.concat(F.lit("sha256:"), digest) == F.col("payload_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))))
    page = F.col("page_id").cast("long")
    # payloads end here
    slim = materialize(found.select("warc_type", "record_id", "refers_to", page.alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("warc_type") == "response", sound).alias("payload_digest")), "records")
    responses = slim.where("warc_type = 'response'")
    by_id = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("of"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisits = slim.where("warc_type = 'revisit'").select("page_id", "refers_to").join(by_id, "refers_to", "left")
    missing = F.raise_error(F.concat(F.lit("no response "), F.col("refers_to")))
    revisits = revisits.select("page_id", "payload_bytes", F.when(F.col("payload_digest").isNull(), missing).otherwise(F.col("payload_digest")).alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def round_trip(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Store pages, write the store's records as WARC files, read the files and resolve them."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/tessera/archive-{uuid.uuid4().hex}"
    store(pages, path, **names)
    write_files(records(spark, path), f"{path}/warc")
    return resolved(read_files(spark, f"{path}/warc"))
