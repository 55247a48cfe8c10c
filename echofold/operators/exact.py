"""Exact duplicates: by size, by hash within a size, and by content itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash: the offset basis and the prime 2^40 + 435.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
_MASK = 0xFFFFFFFF


def fnv1a_hex(content: Column) -> Column:
    """FNV-1a of BINARY as 16 hex digits, without a UDF.

    The hash is held as two halves of 32 bits, as LONG products of whole
    hashes would overflow. For contents of up to some thousand bytes; longer
    ones are faster with fnv1a().
    """
    digits = F.hex(content)
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    values = F.transform(places, lambda p: F.conv(F.substring(digits, p, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET & _MASK).cast("long").alias("lo"))

    def step(h: Column, byte: Column) -> Column:
        low = h["lo"].bitwiseXOR(byte)
        product = low * 435
        hi = (h["hi"] * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(_MASK).cast("long"))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(_MASK).cast("long")).alias("lo"))

    return F.aggregate(values, start, step, lambda h: F.concat(F.lpad(F.lower(F.hex(h["hi"])), 8, "0"), F.lpad(F.lower(F.hex(h["lo"])), 8, "0")))


def fnv1a_bytes(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many contents at once, byte place by byte place."""
    lengths = np.array([len(v) for v in values], np.int64)
    hashes = np.full(len(values), OFFSET, np.uint64)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    flat = np.frombuffer(b"".join(values), np.uint8)
    begin = (np.cumsum(lengths) - lengths)[order]
    many = len(values)
    for at in range(int(lengths.max(initial=0))):
        many = int(np.searchsorted(-sizes[:many], -at, "left"))
        own = order[:many]
        hashes[own] = (hashes[own] ^ flat[begin[:many] + at]) * np.uint64(PRIME)
    return hashes


def fnv1a(df: DataFrame, content: str = "content", name: str = "hash") -> DataFrame:
    """df with the hash of a BINARY column as LONG, for contents of any length; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(content)).to_pylist()
            made = fnv1a_bytes([v or b"" for v in values]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, mask=np.array([v is None for v in values], bool))], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {name} long")


def size_buckets(files: DataFrame) -> DataFrame:
    """Sizes that several files share: only their files need to be hashed."""
    return files.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("files")).where("files >= 2")


def to_hash(files: DataFrame) -> DataFrame:
    """The files whose size is not unique."""
    return files.join(size_buckets(files).select("size_bytes"), "size_bytes", "left_semi")


def exact_groups(files: DataFrame, content: str = "content") -> DataFrame:
    """Groups of byte-identical files: group_id (the smallest), members, size, bytes to reclaim.

    Only files whose size is not unique are hashed. They are grouped by size
    and a 256-bit digest, so no content is shuffled; a digest of that length
    stands for the bytes. A group is one row: exact_members() has large ones.
    """
    keyed = to_hash(files).select("file_id", "size_bytes", F.sha2(F.col(content), 256).alias("digest"))
    grouped = keyed.groupBy("size_bytes", "digest").agg(F.sort_array(F.collect_list("file_id")).alias("members")).where(F.size("members") >= 2)
    return grouped.select(F.col("members")[0].alias("group_id"), "members", "size_bytes", ((F.size("members") - 1) * F.col("size_bytes")).cast("long").alias("reclaimable_bytes"))


def exact_members(files: DataFrame, content: str = "content") -> DataFrame:
    """(group_id, file_id) of duplicates, one row each: for groups too large for one row."""
    keyed = to_hash(files).select("file_id", "size_bytes", F.sha2(F.col(content), 256).alias("digest"))
    first = keyed.groupBy("size_bytes", "digest").agg(F.min("file_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return keyed.join(first, ["size_bytes", "digest"]).select("group_id", "file_id")


def exact_summary(files: DataFrame, content: str = "content") -> DataFrame:
    """One row: files and bytes that had to be hashed, groups, duplicates, bytes to reclaim."""
    shared = to_hash(files)
    hashed = shared.agg(F.count(F.lit(1)).alias("files_hashed"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes_hashed"))
    keyed = shared.select("size_bytes", F.sha2(F.col(content), 256).alias("digest"))
    groups = keyed.groupBy("size_bytes", "digest").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    totals = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("members"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size_bytes")), F.lit(0)).cast("long").alias("reclaimable_bytes"))
    return hashed.crossJoin(totals)
