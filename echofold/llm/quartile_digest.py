"""Quartile bucket digests of texts, and a bounded likeness of two digests.

Six byte triplets of every five-byte window are hashed into 128 buckets. Each
bucket's count is coded by the quartile of the counts that it falls into, two
bits each; a head codes the length on a logarithmic scale, the ratios of the
quartiles and a check byte. Two digests are compared by the sum of their
buckets' and heads' differences, bounded by BOUND.

A null text is empty. Texts under SHORT bytes have too few triplets for
quartiles, and most of their buckets would be zero: the bits of a hash of the
whole text stand there instead, so that such a text is like an equal one, and
as unlike all others as unrelated texts are. The next document is the one with
the next smaller doc_id (null ids come last; after the last comes the first);
rows with equal ids follow each other by text. A single row is its own next.
Very long texts are counted whole, BLOCK bytes at a time. Other columns are
left out. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm._common import parts, table, written

BUCKETS = 128
#: The difference from which on two digests have nothing in common.
BOUND = 300
#: Bytes that a text must have for its triplets to be counted.
SHORT = 8
#: Bytes of one text that are counted at once.
BLOCK = 1 << 18
_SEED = np.random.RandomState(20240)
#: Tabulation hashing: one table for each place of a triplet, one number for each choice of places.
_TABLES = [_SEED.randint(0, BUCKETS, 256).astype(np.uint8) for _ in range(3)]
_PLACES = [((0, 1, 2), 0), ((0, 1, 3), 37), ((0, 2, 3), 74), ((0, 1, 4), 11), ((0, 2, 4), 48), ((0, 3, 4), 85)]
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bucket_counts(raw: bytes) -> np.ndarray:
    """How many triplets of a text fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(raw, np.uint8)
    for a in range(0, max(0, len(data) - 4), BLOCK):
        x = data[a : a + BLOCK + 4]
        n = len(x) - 4
        by_place = [t[x] for t in _TABLES]
        for (i, j, k), salt in _PLACES:
            made = by_place[0][i : n + i] ^ by_place[1][j : n + j] ^ by_place[2][k : n + k] ^ np.uint8(salt)
            counts += np.bincount(made, minlength=BUCKETS)
    return counts


def _quarters(body: bytes) -> np.ndarray:
    """Four codes of two bits for each byte."""
    b = np.frombuffer(body, np.uint8)
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], 1).ravel().astype(np.int16)


def digest(raw: bytes) -> np.ndarray:
    """A digest as numbers: check byte, length code, two ratios, then the buckets' quartiles."""
    if len(raw) < SHORT:
        return np.concatenate([np.array([zlib.crc32(raw) & 255, min(255, round(8 * math.log2(len(raw) + 1))), 0, 0], np.int16), _quarters(sha256(raw).digest())])
    counts = bucket_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    head = [zlib.crc32(raw) & 255, min(255, round(8 * math.log2(len(raw) + 1))), int(16 * q1 / q3) % 16 if q3 else 0, int(16 * q2 / q3) % 16 if q3 else 0]
    codes = (counts > q1).astype(np.int16) + (counts > q2) + (counts > q3)
    return np.concatenate([np.array(head, np.int16), codes])


def as_text(d: np.ndarray) -> str:
    """A digest in hex: 2 digits of check, 2 of length, 2 of ratios, 64 of quartiles."""
    quarters = d[4:].astype(np.uint8).reshape(-1, 4)
    body = quarters[:, 0] | quarters[:, 1] << 2 | quarters[:, 2] << 4 | quarters[:, 3] << 6
    return f"{d[0]:02x}{d[1]:02x}{d[2]:x}{d[3]:x}" + body.astype(np.uint8).tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.concatenate([np.array([int(text[:2], 16), int(text[2:4], 16), int(text[4], 16), int(text[5], 16)], np.int16), _quarters(bytes.fromhex(text[6:]))])


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 for equal digests, at most BOUND.

    Opposite quartiles count six, others their distance. An eighth of a
    doubling in length counts one; ratios count their circular distance.
    """
    apart = np.abs(a[4:] - b[4:])
    total = int(apart.sum()) + 3 * int((apart == 3).sum())
    total += int(a[0] != b[0]) + abs(int(a[1]) - int(b[1]))
    for k in (2, 3):
        d = abs(int(a[k]) - int(b[k]))
        total += min(d, 16 - d)
    return min(total, BOUND)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The text, its last half replaced by as many first code points of the next (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    new = edited(text, following).encode("utf-8", "surrogatepass")
    made = digest(new)
    return (doc_id, len(text), sha256(new).hexdigest(), as_text(own), as_text(made), likeness(own, made), likeness(own, other))


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each text, without comparing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [as_text(digest((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and its next document, by FIELDS.

    Rows are dealt into ranges of doc_id and sorted within each, so a next
    document stands beside its own, except at the ends of the ranges. Each
    range hands out its first and last row; the last is compared with the first
    of the range that follows. The texts move once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    ranged = rows.repartitionByRange(parts(spark), order[0]).sortWithinPartitions(*order)
    schema = FIELDS + ", edge string, edge_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        last = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*_TYPES, pa.string(), pa.string()))], names=[*_NAMES, "edge", "edge_text"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                own = digest(text.encode("utf-8", "surrogatepass"))
                if last is None:
                    made.append((doc_id, None, None, as_text(own), None, None, None, "first", text))
                else:
                    made.append((*_compare(*last, text, own), None, None))
                last = (doc_id, text, own)
                if len(made) >= 1000:
                    yield batch_of(made)
                    made = []
        if last is not None:
            made.append((last[0], None, None, as_text(last[2]), None, None, None, "last", last[1]))
            yield batch_of(made)

    whole = written(ranged.mapInArrow(run, schema), "digests")
    inner = whole.where("edge IS NULL").drop("edge", "edge_text")
    edges = whole.where("edge IS NOT NULL")
    # One pair of ids for each range comes to the driver: as many as there are partitions.
    ends = edges.select("doc_id", "edge").collect()
    key = lambda i: (i is None, -(i or 0))
    first, last = (sorted((r["doc_id"] for r in ends if r["edge"] == e), key=key) for e in ("first", "last"))
    if not first:
        return inner
    following = spark.createDataFrame(list(zip(last, first[1:] + first[:1])), "_last long, _first long")
    lasts = edges.where("edge = 'last'").select("doc_id", "edge_text", "fingerprint")
    firsts = edges.where("edge = 'first'").select(F.col("doc_id").alias("_id"), F.col("edge_text").alias("_text"), F.col("fingerprint").alias("_print"))
    pairs = lasts.join(following, F.col("doc_id").eqNullSafe(F.col("_last"))).join(firsts, F.col("_first").eqNullSafe(F.col("_id")))

    def ends_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compare(i, t, from_text(p), u, from_text(q)) for i, t, p, u, q in zip(*(batch.column(k).to_pylist() for k in range(5)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    outer = pairs.select("doc_id", "edge_text", "fingerprint", "_text", "_print").mapInArrow(ends_compared, FIELDS)
    return inner.unionByName(outer)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """SQL that makes the same rows byte by byte, from lists of windows and a folded checksum."""
    by_byte = ", ".join(f"({b}, {', '.join(str(t[b]) for t in _TABLES)})" for b in range(256))
    crc = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        crc.append(b)
    made = ", ".join(f"xor(xor(xor(a{i}, b{j}), c{k}), {salt})" for (i, j, k), salt in _PLACES)
    quarter = BUCKETS // 4
    apart = """least({bound}, list_sum(list_transform(list_zip({a}.codes, {b}.codes), lambda x: abs(x[1] - x[2]) + 3 * (abs(x[1] - x[2]) = 3)::INT))
        + ({a}.chk <> {b}.chk)::INT + abs({a}.size - {b}.size)
        + least(abs({a}.r1 - {b}.r1), 16 - abs({a}.r1 - {b}.r1)) + least(abs({a}.r2 - {b}.r2), 16 - abs({a}.r2 - {b}.r2)))"""
    alike = lambda b: f"1.0::DOUBLE - {apart.format(bound=BOUND, a='o', b=b)}::DOUBLE / {BOUND}"
    return f"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, row_number() OVER w AS rn, count(*) OVER () AS n
    FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)
), both_texts AS (
    SELECT d.rn, d.doc_id, f.rn AS next_rn, d.text, length(d.text) AS n_chars,
        left(d.text, length(d.text) - length(d.text) // 2) || left(f.text, length(d.text) // 2) AS edited
    FROM docs d JOIN docs f ON f.rn = d.rn % d.n + 1
), texts AS (
    SELECT rn, 'own' AS kind, text FROM both_texts UNION ALL SELECT rn, 'edited', edited FROM both_texts
), pairs AS MATERIALIZED (
    SELECT rn, kind, sha256(text) AS sha, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT) AS bytes FROM texts
), heads AS (
    SELECT rn, kind, sha, len(bytes) AS n_bytes, least(255, round(8 * log2(len(bytes) + 1)))::INT AS size,
        (xor(list_reduce(bytes, lambda r, x: xor(r >> 8, ({crc}::BIGINT[])[(xor(r, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) & 255)::INT AS chk
    FROM (SELECT rn, kind, sha, bytes::BIGINT[] AS bytes FROM pairs)
), tab(byte, h0, h1, h2) AS (VALUES {by_byte}),
places AS (SELECT rn, kind, unnest(bytes) AS byte, generate_subscripts(bytes, 1) AS i FROM pairs WHERE len(bytes) >= {SHORT}),
windows AS (
    SELECT rn, kind, h0 AS a0, lead(h1, 1) OVER w AS b1, lead(h1, 2) OVER w AS b2, lead(h1, 3) OVER w AS b3,
        lead(h2, 2) OVER w AS c2, lead(h2, 3) OVER w AS c3, lead(h2, 4) OVER w AS c4
    FROM places JOIN tab USING (byte) WINDOW w AS (PARTITION BY rn, kind ORDER BY i)
), counted AS (
    SELECT rn, kind, bucket, count(*) AS c FROM (SELECT rn, kind, unnest([{made}]) AS bucket FROM windows WHERE c4 IS NOT NULL) GROUP BY ALL
), full_counts AS (
    SELECT h.rn, h.kind, list(coalesce(c, 0) ORDER BY v) AS counts
    FROM heads h CROSS JOIN range({BUCKETS}) r(v) LEFT JOIN counted k ON k.rn = h.rn AND k.kind = h.kind AND k.bucket = v
    WHERE n_bytes >= {SHORT} GROUP BY ALL
), quartiles AS (
    SELECT rn, kind, counts, list_sort(counts)[{quarter}] AS q1, list_sort(counts)[{2 * quarter}] AS q2, list_sort(counts)[{3 * quarter}] AS q3 FROM full_counts
), digests AS MATERIALIZED (
    SELECT rn, kind, chk, size, CASE WHEN q3 > 0 THEN 16 * q1 // q3 % 16 ELSE 0 END AS r1, CASE WHEN q3 > 0 THEN 16 * q2 // q3 % 16 ELSE 0 END AS r2,
        list_transform(counts, lambda c: (c > q1)::INT + (c > q2)::INT + (c > q3)::INT) AS codes
    FROM heads JOIN quartiles USING (rn, kind)
    UNION ALL
    SELECT rn, kind, chk, size, 0, 0, list_transform(range({BUCKETS}), lambda v: (('0x' || substr(sha, (v // 4 * 2 + 1)::INT, 2))::INT >> (v % 4 * 2)::INT) & 3)
    FROM heads WHERE n_bytes < {SHORT}
), printed AS MATERIALIZED (
    SELECT *, printf('%02x%02x%x%x', chk, size, r1, r2) || list_aggregate(list_transform(range({quarter}),
        lambda m: printf('%02x', codes[4 * m + 1] + 4 * codes[4 * m + 2] + 16 * codes[4 * m + 3] + 64 * codes[4 * m + 4])), 'string_agg', '') AS fingerprint
    FROM digests
)
SELECT t.doc_id, t.n_chars, sha256(t.edited) AS edited_sha256, o.fingerprint, e.fingerprint AS edited_fingerprint,
    {alike("e")} AS near_edited, {alike("f")} AS near_next
FROM both_texts t
JOIN printed o ON o.rn = t.rn AND o.kind = 'own'
JOIN printed e ON e.rn = t.rn AND e.kind = 'edited'
JOIN printed f ON f.rn = t.next_rn AND f.kind = 'own'
"""


ORACLE = _oracle()
