"""WARC archives with revisit records for payloads that are stored elsewhere.

Headers only (page_id, digest, length) are shuffled by payload digest; the
largest id of each digest keeps its payload as a response, all others become
revisit records that refer to it. Archives hold one gzip member per record and
are written to the shared folder, each under a name of its own task attempt
first and then renamed, so that a task that is run twice leaves one file.

A payload is the html in UTF-8; null is empty. Null page ids are written with
an empty id and compare as the smallest. Repeated rows each get their own
record; rows of one page_id with equal payloads are of the same type. An empty
table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm._common import parts, shared_dir, table, written

#: An archive file is closed and a new one begun beyond so many compressed bytes.
ARCHIVE_BYTES = 32 << 20
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_column(payload: str):
    """SHA-1 of a string column in bare upper-case base32, as a JVM expression."""
    sha = F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary"))
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Rows (page_id, url, html, digest, record_type, refers_to) for the pages.

    Payloads of fewer than `least` bytes are never shared: all are responses.
    Only digests that occur twice or more are joined back; the join's large
    side can be split where one digest is very frequent.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", digest_column("html"))
    least_id = F.lit(-(2**63))
    heads = rows.where(F.octet_length("html") >= least).select("digest", "page_id", F.coalesce("page_id", least_id).alias("place"))
    last = heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("top")).where("n > 1").drop("n")
    # Payloads move once, by page and digest, so that a frequent digest is spread over all tasks.
    shared = heads.join(last, "digest").where("place < top").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("top").alias("refers_to")).distinct()
    joined = rows.join(shared, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left").drop("_p", "_d")
    return joined


def _head(kind: str, page_id: int | None, url: str, digest: str, n: int, refers_to: int | None, payload: bytes) -> bytes:
    """A record: fresh WARC headers, HTTP headers with the payload's length, and the payload itself for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + payload
    own = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path within it; Hadoop's names of S3 count as S3."""
    scheme, colon, rest = path.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"s3{colon}{rest}" if scheme in ("s3a", "s3n") else path)


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Write the planned records under path; rows (name, n_records) of the files.

    The work runs once, by the action that writes the small list of names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(path)
        task = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        fs.create_dir(top, recursive=True)
        part, out, size, n, draft = 0, None, 0, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{task:06d}-{part:04d}.warc.gz"
            fs.move(draft, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            columns = [batch.column(k) for k in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    draft = f"{top}/.{attempt}-{part}"
                    out, size, n = fs.open_output_stream(draft, compression=None), 0, 0
                payload = html.encode("utf-8", "surrogatepass")
                url = (url or "").replace("\r", "").replace("\n", "")
                raw = _head("revisit" if refers_to is not None else "response", page_id, url, digest, len(payload), refers_to, b"" if refers_to is not None else payload)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    part, out = part + 1, None
        if out is not None:
            yield close()

    columns = records.select("page_id", "url", "html", "digest", "refers_to")
    return written(columns.mapInArrow(write, "name string, n_records long"), "warc-names")


def records_in(raw: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip archive, read as a stream."""
    # One record at a time is unpacked: memory is bounded by the largest record.
    packed = b""
    while True:
        unpack, plain = zlib.decompressobj(31), []
        while not unpack.eof:
            if not packed:
                packed = raw.read(1 << 18)
                if not packed:
                    if plain:
                        raise ValueError("an archive ends inside a record")
                    return
            plain.append(unpack.decompress(packed))
            packed = unpack.unused_data
        record = b"".join(plain)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_archives(names: DataFrame, path: str) -> DataFrame:
    """The records of the named archives, one row each, as RECORD_SCHEMA says.

    A response's digest and length are taken anew from its payload and must
    equal its headers; a revisit has those of its HTTP and WARC headers.
    """

    def number(urn: str) -> int | None:
        return int(urn[len(URN) + 1 : -1]) if len(urn) > len(URN) + 2 else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(path)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as raw:
                    for headers, block in records_in(raw):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response":
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if (found, len(payload)) != (digest, n):
                                raise ValueError(f"{name}: payload of {headers['WARC-Record-ID']} does not fit its headers")
                        rows.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], n, digest, kind, number(headers.get("WARC-Refers-To", "")), payload if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    spread = names.repartition(parts(names.sparkSession), F.xxhash64("name"))
    return spread.mapInArrow(read, RECORD_SCHEMA)


def restore(records: DataFrame) -> DataFrame:
    """Every record with its payload: revisits get that of the response with their digest."""
    whole = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max_by("payload", "page_id").alias("original"))
    revisits = records.where("record_type = 'revisit'").join(whole, "payload_digest", "left")
    return records.where("record_type = 'response'").unionByName(revisits.withColumn("payload", F.col("original")).drop("original"))


def deduplicate(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Pages written to archives under path; the names of the files."""
    return write_archives(plan_records(pages, least), path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    names = deduplicate(table(spark, sf_dir, "pages"), path)
    # Without payloads the records are small; written once, the archives are read a single time.
    read = written(read_archives(names, path).drop("payload", "url"), "warc-read")
    # A revisit refers to the response that its digest leads to, not to what a header claims alone.
    found = read.where("record_type = 'response'").select("payload_digest", F.col("page_id").alias("refers_to"), F.lit(True).alias("known")).distinct()
    revisits = read.where("record_type = 'revisit'").join(found, ["payload_digest", "refers_to"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    revisits = revisits.withColumn("refers_to", F.when(F.col("known"), F.col("refers_to")).otherwise(lost)).select(*read.columns)
    out = read.where("record_type = 'response'").unionByName(revisits)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = " || ".join(f"to_base(('0x' || s[{1 + 10 * i}:{10 + 10 * i}])::BIGINT, 32, 8)" for i in range(4))
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, n, translate({_B32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to FROM t
"""
