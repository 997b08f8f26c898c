"""WARC archives: writing with deduplication, and reading by boundary-chain verification.

Writing: every page becomes one record, as UTF-8 text that Spark's own writer
puts into compressed files of at most ``FILE_RECORDS`` records in the shared
folder.  Of pages with equal payloads the smallest id is the response and the
others are revisit records without a payload.

Reading: a task looks at the bytes of a file and emits a candidate for every
record magic, with the offset of the record and of its successor, which follows
from the declared length.  A magic inside a payload gives a candidate too.  The
candidates of a file are few numbers each; pointer jumping over the successors,
which doubles the distance each round, marks those that can be reached from the
start of the file, and only they are records.

Edge cases: a null html is an empty payload; a null page_id is kept as such, and
never the response for another page unless no page of the payload has an id;
urls lose line breaks and a null url is left out; an empty table gives no rows;
further columns are ignored.  Rows that repeat the smallest id of a payload are
all responses.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm.store import fresh_path

FILE_RECORDS = 1000
LEAST_BYTES = 100
MAGIC = b"WARC/1.1\r\n"
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SCHEMA = "file string, at long, next long, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long, sound boolean"


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, bytes, digest, and first (the response's page_id) for revisits.

    Only digests are shuffled, not payloads: the copies of a payload are found by a grouping with partial
    aggregation, and the few digests that occur more than once come back by a join that may split hot keys.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\\r\\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    copies = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    revisit = F.expr("coalesce(n > 1, false) and not (page_id <=> response)")
    return rows.join(copies, "digest", "left").select("page_id", "url", "payload", "bytes", "digest", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, file_records: int = FILE_RECORDS) -> None:
    """One record a page.  The two line breaks after a record are the writer's line separator."""
    planned = plan_records(pages, least)
    body = F.when(F.col("revisit"), F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), "payload"))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit(MAGIC.decode()), F.when(F.col("revisit"), F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")), field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))),
        field("WARC-Target-URI", F.col("url")), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), field("WARC-Payload-Length", F.col("bytes")),
        field("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">")))), field("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), field("Content-Length", F.octet_length("body")), F.lit("\r\n"),
    )
    planned.withColumn("body", body).select(F.concat(head, "body").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def candidates(name: str, data: bytes) -> list[tuple]:
    """Every place where a record may begin, with the offset after it (-1 where no record can be read there) and what it says."""
    out, at = [], data.find(MAGIC)
    while at >= 0:
        stop = data.find(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v for k, v in _FIELD.findall(data, at + len(MAGIC), stop + 2)} if stop >= 0 else {}
        length = fields.get(b"content-length", b"")
        end = stop + 4 + int(length) if length.isdigit() and len(length) < 19 else -1
        if 0 <= end <= len(data) - 4 and data[end : end + 4] == b"\r\n\r\n":
            kind = fields.get(b"warc-type", b"").decode("latin-1")
            page = re.search(rb"-?\d+", fields.get(b"warc-record-id", b""))
            other = re.search(rb"-?\d+", fields.get(b"warc-refers-to", b""))
            digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
            size = fields.get(b"warc-payload-length", b"")
            if kind == "revisit":
                n, found, sound = int(size) if size.isdigit() else None, digest, True
            else:
                body = data.find(b"\r\n\r\n", stop + 4, end) + 4
                payload = memoryview(data)[body if body >= 4 else stop + 4 : end]
                n, found = len(payload), hashlib.sha256(payload).hexdigest()
                sound = not digest or digest == found
            out.append((name, at, end + 4, kind, int(page[0]) if page else None, n, found, int(other[0]) if other else None, sound))
        else:
            out.append((name, at, -1, None, None, None, None, None, False))
        at = data.find(MAGIC, at + 1)
    return out


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the ascending offsets a chain of successors from 0 meets: pointer jumping, log2(n) rounds."""
    n = len(at)
    jump = np.searchsorted(at, following)
    jump = np.where((jump < n) & (at[np.minimum(jump, n - 1)] == following), jump, n)
    jump = np.append(jump, n)
    reached = np.append(at == 0, False)
    for _ in range(max(1, n.bit_length())):
        reached[jump[:-1][reached[:-1]]] = True
        reached[n] = False
        jump = jump[jump]
    return reached[:n]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path, compressed or not."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def scan(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                found = candidates(name, data)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)], names=_NAMES)

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        return table.filter(pa.array(reachable(table["at"].to_numpy(), table["next"].to_numpy())))

    # the copies of a file's bytes end with the scan; a file's candidates are at most a few thousand numbers
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, str(min(64, int(spark.conf.get(conf)))))
    return files.mapInArrow(scan, _SCHEMA).groupBy("file").applyInArrow(chain, _SCHEMA)


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM r""",
}
QUERIES = {"op9_warc": op9_warc}
