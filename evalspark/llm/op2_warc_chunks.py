"""WARC archives as a chunked record table.

Records travel as rows of (record identifier, chunk number, bytes): an
oversized payload is never one Python object or one Arrow row, in either
direction.  Each writing task streams its chunk rows into one archive in the
shared folder, one gzip member per record, and returns a manifest row; the
manifest is a written table, so archives of failed or repeated attempts are
never read.  Reading gives each archive to a task, which parses it as a stream
and emits chunk rows with the digest and size of the payload so far; the last
chunk's digest is checked against the header's.

Archive folders are opened with ``pyarrow.fs`` (local and shared mounts, HDFS,
S3, GCS); the tables around them are read by Spark.

Payloads that were seen before may be written as revisit records, which hold
the HTTP header and a reference (``mark_revisits``).  A null payload is empty;
an empty payload is one empty chunk.  An empty table writes no archive.
Records with a null target get no target header.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import materialise, small_arrow_batches, table
from evalspark.session import ensure_checkpoint_dir, scratch_path

QUERY = "op2_warc_chunks"
CHUNK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = ("record_id string, record_type string, target string, refers_to string, "
                "header_digest string, payload_bytes bigint, chunk_no bigint, chunk binary, "
                "seen_bytes bigint, seen_digest string, last boolean")


def mark_revisits(records: DataFrame, least: int = 1000) -> DataFrame:
    """Add record_type and refers_to: of records with equal payloads of at least
    ``least`` bytes the one with the largest ``rank`` is a response, the others
    revisit it.  ``records``: record_id, rank (unique), payload."""
    digest, size = F.sha2("payload", 256), F.octet_length("payload")
    # Written first, so that the join stands alone in its stage and Spark can
    # split the partition of a payload with very many records.
    firsts = materialise(
        records.filter(size >= least).groupBy(digest.alias("_digest"))
        .agg(F.max(F.struct("rank", "record_id")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").drop("_n"), "warc-firsts")
    revisit = (size >= least) & (F.col("_first.record_id") != F.col("record_id"))
    return (records.withColumn("_digest", digest).join(firsts, "_digest", "left")
            .withColumn("refers_to", F.when(revisit, F.col("_first.record_id")))
            .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
            .drop("_digest", "_first"))


def to_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of ``records`` (record_id, record_type, target, refers_to, payload), in order."""
    payload = F.coalesce(F.col("payload"), F.lit("").cast("binary"))
    size = F.octet_length(payload).cast("bigint")
    body = F.when(F.col("record_type") == "response", size).otherwise(0)
    return (records.withColumn("payload", payload)
            .withColumn("payload_bytes", size).withColumn("digest", F.sha1("payload"))
            .withColumn("chunks", F.greatest(F.ceil(body / F.lit(chunk)), F.lit(1)))
            .withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
            .select("record_id", "record_type", "target", "refers_to", "payload_bytes", "digest",
                    "chunk_no", "chunks",
                    F.when(F.col("record_type") == "response",
                           F.col("payload").substr((F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)))
                    .otherwise(F.lit("").cast("binary")).alias("chunk")))


def _head(r, date: str) -> bytes:
    """The WARC and HTTP headers of a record."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            f"Content-Length: {r.payload_bytes}\r\n\r\n").encode()
    length = len(http) + (r.payload_bytes if r.record_type == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {r.record_type}", f"WARC-Record-ID: <{r.record_id}>",
             f"WARC-Date: {date}"]
    if r.target is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in r.target if c >= " "))
    if r.record_type == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{r.refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{r.digest}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per partition of ``chunks`` (see ``to_chunks``) and
    return the manifest: path, records, bytes."""
    small_arrow_batches(chunks.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        out = member = None
        records = 0
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:
                    system, where = fs.FileSystem.from_uri(path)
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(where, compression=None)
                if r.chunk_no == 0:
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(_head(r, date)))
                out.write(member.compress(r.chunk))
                if r.chunk_no + 1 == r.chunks:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})

    return materialise(chunks.mapInPandas(write, "path string, records bigint, bytes bigint"), "warc-manifest")


def _headers(stream) -> dict:
    found = {}
    for line in iter(stream.readline, b""):
        line = line.rstrip(b"\r\n")
        if not line:
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_records(stream, chunk: int) -> Iterator[tuple]:
    """Chunk rows of the response and revisit records of an archive's bytes."""
    bare = lambda v: v.strip("<>") if v else None
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.strip():
            continue  # the blank lines that end a record
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = _headers(stream)
        left, kind = int(head["content-length"]), head["warc-type"]
        size = None
        if head.get("content-type", "").startswith("application/http"):
            http = b""
            while left:  # the HTTP header's lines, up to the blank one
                line = stream.readline(left)
                left -= len(line)
                http += line
                if not line.strip():
                    break
            fields = _headers(io.BytesIO(http.partition(b"\r\n")[2]))
            size = int(fields["content-length"]) if "content-length" in fields else None
        own = kind in ("response", "revisit")
        fixed = (bare(head.get("warc-record-id")), kind, head.get("warc-target-uri"),
                 bare(head.get("warc-refers-to")), head.get("warc-payload-digest", "").rpartition(":")[2])
        digest, seen, n = hashlib.sha1(), 0, 0
        while own or left:
            data = stream.read(min(left, chunk))
            if left and not data:
                raise ValueError("the archive ends within a record")
            left -= len(data)
            seen += len(data)
            if own:
                digest.update(data)
                yield (*fixed, size if kind == "revisit" else seen + left, n, data, seen,
                       digest.hexdigest(), left == 0)
            n += 1
            if not left:
                break


def read_archives(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table (CHUNK_SCHEMA) of the archives that ``manifest`` lists.
    ``seen_digest`` and ``seen_bytes`` cover the payload up to that chunk."""
    small_arrow_batches(manifest.sparkSession)
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        for b in batches:
            for path in b["path"]:
                system, where = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(where, compression=None) as raw, \
                        gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 18)) as stream:
                    for row in read_records(stream, chunk):
                        rows.append(row)
                        held += len(row[7]) + 500
                        if held > 4 * CHUNK:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = max(1, manifest.count())
    return manifest.repartition(files, "path").select("path").mapInPandas(read, CHUNK_SCHEMA)


def checked(chunks: DataFrame) -> DataFrame:
    """One row per record: its last chunk, with the full payload's digest.  A
    response whose bytes do not match its header fails the job."""
    good = ((F.col("record_type") == "revisit") | (F.col("seen_digest") == F.col("header_digest")))
    return chunks.filter("last").select(
        "record_id", "record_type", "target", "refers_to", "payload_bytes",
        F.when(good, F.col("header_digest"))
        .otherwise(F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("record_id"))))
        .alias("payload_digest"))


def _uri(page: str, at: str):
    """A record identifier that holds the page's id."""
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")),
                    F.lit(":"), F.lower(F.hex(F.xxhash64(at))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("target"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    records = pages.select(_uri("page_id", "at").alias("record_id"), "target", "payload",
                           F.struct("page_id", "at").alias("rank"))
    manifest = write_archives(to_chunks(mark_revisits(records)), scratch_path(spark, "warc"))
    page = lambda c: F.split(c, ":")[2].try_cast("bigint")
    return checked(read_archives(manifest)).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> first THEN first END AS refers_to
FROM r
"""
