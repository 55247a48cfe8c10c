"""Comparison of a query with its SQL in DuckDB, and small images."""

from __future__ import annotations

import math
import os
import struct
import zlib

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("ECHOFOLD_TESTDATA", "/root/testdata")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def same_rows(df, sql: str, con) -> None:
    """Both sides have the same columns and the same rows, in any order."""
    cols = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"SELECT {names} FROM ({sql})").fetchall()
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(plain(v) for v in r)) for r in want)


def png(pixels: list[list[tuple[int, int, int]]]) -> bytes:
    """A PNG of RGB rows."""
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg(spark, pixels: list[list[tuple[int, int, int]]]) -> bytes:
    """A JPEG of RGB rows, by the JVM's encoder."""
    jvm = spark.sparkContext._jvm
    h, w = len(pixels), len(pixels[0])
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = pixels[y][x]
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())
