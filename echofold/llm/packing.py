"""Best-fit packing planned on a histogram of lengths.

Only counts of lengths reach the driver (at most `width` of them): best-fit in
descending order of length is run over counts, which gives patterns of
sequences with a repeat count. Pieces then take the planned slots by their rank
within their length. A text longer than `width` tokens is cut into pieces of
`width`, the first of which takes the remainder.

Null text is empty: one piece of one token (the end token). Repeated rows and
null ids are packed like any other row. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echofold.llm._common import lean, parts, table, written

WIDTH = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Ranks within a length are counted in so many shares per shuffle partition, so that a frequent length is spread.
SHARES = 4

_encoders: dict[str, object] = {}


def encoder(name: str = "byte_bpe_50k"):
    """text -> ids, with the ids of the tokenizer file `name`.json.

    The rank file of the same vocabulary gives the same ids several times
    faster; tests hold the two against each other for every code point.
    """
    if name not in _encoders:
        import tiktoken

        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        lines = map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)

        _encoders[name] = encode
    return _encoders[name]


def cut(n: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text with n tokens."""
    first = n % width or min(n, width)
    return [(0, first)] + [(k, width) for k in range(first, n, width)]


def pieces(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every text's tokens and end token as pieces, by PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                rows += [(doc_id, k, a, n, zlib.crc32(ids[a : a + n])) for k, (a, n) in enumerate(cut(len(ids), width))]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def plan(counts: dict[int, int], width: int = WIDTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit in descending length over counts.

    Returns slots (length, first rank, sequences' first number, pieces of that
    length in one sequence, offset of the first) and the number of sequences.
    Ranks of a length from a slot's first on up to the next slot's belong to
    it. The number of slots grows with `width`, never with the data.
    """
    open_by_room: dict[int, list[tuple[int, int]]] = {width: []}  # room -> runs (first number, how many) of equal sequences
    rooms: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    total = 0

    def keep(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            if room not in open_by_room or not open_by_room[room]:
                open_by_room[room] = []
                bisect.insort(rooms, room)
            open_by_room[room].append(run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms.pop(at)
            else:
                room, first, many = width, total, -(-left // (width // length))
                total += many
            each = min(room // length, left)
            full = min(many, left // each)
            slots.append((length, rank, first, each, width - room))
            keep(room - each * length, (first, full))
            keep(room, (first + full, many - full))
            left, rank = left - full * each, rank + full * each
    return slots, total


def place(cut_pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    shares = SHARES * parts(spark)
    rows = cut_pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    counted = rows.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("share").rowsBetween(W.unboundedPreceding, -1))
    offsets = counted.select("length", "share", F.coalesce(before, F.lit(0)).alias("before"))
    # At most `width` rows come to the driver, whatever the number of documents.
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(counts, width)
    rank = F.row_number().over(W.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("own", rank).join(offsets, ["length", "share"]).withColumn("rank", (F.col("own") + F.col("before")).cast("long"))
    table_of = {}
    for length, first, number, each, offset in slots:
        table_of.setdefault(length, []).append((first, number, each, offset))
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in table_of.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(at) else []:
                n = length[own[0]]
                first, number, each, begin = shared.value[n]
                slot = np.searchsorted(first, at[own], side="right") - 1
                k = at[own] - first[slot]
                sequence[own] = number[slot] + k // each[slot]
                offset[own] = begin[slot] + k % each[slot] * n
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents packed. The pieces are written once: tokens are made a single time."""
    return place(written(pieces(docs, width), "pieces"), width)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
