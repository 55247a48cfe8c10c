"""Images decoded once, with every size, hash and feature that is derived from their pixels."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.signatures import HASHES, box_edges, phash_values
from echofold.sources.files import format_of, sniff

# Weights of red, green and blue in gray, by the convention of each format.
GRAY = {"jpeg": (0.299, 0.587, 0.114), "png": (0.2126, 0.7152, 0.0722)}
LUMA = (0.299, 0.587, 0.114)
DECODED = "path string, format string, width int, height int, " + ", ".join(f"{h} long" for h in HASHES) + ", mean_brightness float, contrast float, histogram array<float>, error string"


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Integer means of boxes, cut off; [h, w] or [h, w, channels]."""
    out = np.empty((height, width, *image.shape[2:]), np.uint8)
    sums = np.pad(image.astype(np.int64), [(1, 0), (1, 0), *[(0, 0)] * (image.ndim - 2)]).cumsum(0).cumsum(1)
    for y, (a, b) in enumerate(box_edges(image.shape[0], height)):
        for x, (c, d) in enumerate(box_edges(image.shape[1], width)):
            out[y, x] = (sums[b, d] - sums[a, d] - sums[b, c] + sums[a, c]) // ((b - a) * (d - c))
    return out


def shrink(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """A first halving by powers of two, as JPEG decoders do, while twice the target is left on both sides."""
    scale = 1
    while scale < 8 and image.shape[1] // (2 * scale) >= width and image.shape[0] // (2 * scale) >= height:
        scale *= 2
    if scale > 1:
        image = resize(image, -(-image.shape[1] // scale), -(-image.shape[0] // scale))
    return resize(image, width, height)


def _bits(tests: np.ndarray) -> int:
    return int((tests.ravel().astype(np.uint64) << np.arange(tests.size, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def ahash_of(small: np.ndarray) -> int:
    return _bits(small > int(small.sum(dtype=np.int64)) // small.size)


def dhash_of(wide: np.ndarray) -> int:
    return _bits(wide[:8, :-1] > wide[:8, 1:])


#: How each format comes to a smaller size: JPEG is halved while it is decoded, PNG is not.
SMALLER = {"jpeg": shrink, "png": resize}


def hashes_of(gray: np.ndarray, kind: str = "jpeg") -> dict[str, int]:
    """All seven hashes of a gray image of any size."""
    smaller = SMALLER[kind]
    upright, square = smaller(gray, 9, 8), smaller(gray, 9, 9)
    turn = lambda k: np.ascontiguousarray(np.rot90(square, -k))
    return {
        "ahash": ahash_of(smaller(gray, 8, 8)),
        "dhash": dhash_of(upright),
        "phash": int(phash_values(smaller(gray, 32, 32)[None]).view(np.int64)[0]),
        "dhash_mirror": dhash_of(upright[:, ::-1]),
        "dhash_rot90": dhash_of(turn(1)),
        "dhash_rot180": dhash_of(turn(2)),
        "dhash_rot270": dhash_of(turn(3)),
    }


def features_of(rgb: np.ndarray, kind: str = "jpeg") -> tuple[np.float32, np.float32, np.ndarray]:
    """Mean brightness, contrast and colour histogram of an image shrunk to 32 by 32."""
    small = SMALLER[kind](rgb, 32, 32).astype(np.int64)
    bins = (small[..., 0] >> 6) * 16 + (small[..., 1] >> 6) * 4 + (small[..., 2] >> 6)
    light = small @ np.array(LUMA)
    deviation = np.sqrt(max(0.0, float((light**2).mean() - light.mean() ** 2)))
    return np.float32(light.mean()), np.float32(deviation), (np.bincount(bins.ravel(), minlength=64) / 1024).astype(np.float32)


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB from the bytes of Spark's image source, which are BGR or BGRA; transparency is dropped."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return image.repeat(3, 2) if channels == 1 else image[:, :, 2::-1]


def gray_of(rgb: np.ndarray, kind: str) -> np.ndarray:
    """Gray levels, halves to even. Channels are added one after the other, as a matrix product may not do."""
    r, g, b = GRAY[kind]
    return np.rint(rgb[..., 0] * r + rgb[..., 1] * g + rgb[..., 2] * b).astype(np.uint8)


def _kinds(origin: str) -> tuple[str, ...]:
    """The format of a file on this machine, by its first bytes; both where the file lies elsewhere."""
    if not origin.startswith(("file:", "/")):
        return tuple(SMALLER)
    path = unquote(urlsplit(origin).path) if origin.startswith("file:") else origin
    try:
        return (sniff(path) or "jpeg",)
    except OSError:
        return tuple(SMALLER)


def decode(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Hashes and features of every image file, by DECODED; what can't be decoded has an error.

    A file's format is told by its first bytes, never by its name. Files that
    workers can't open themselves are made into rows of both formats, of which
    a second look at their contents keeps one.
    """
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(paths)
    flat = raw.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):  # one image's pixels at a time
                origin, height, width, channels, data = (batch.column(k)[i].as_py() for k in range(5))
                if height is None or height <= 0:
                    rows.append({"path": origin, "error": "corrupt or unsupported image"})
                    continue
                rgb = pixels(height, width, channels, data)
                for kind in _kinds(origin):
                    gray = rgb[:, :, 0] if channels == 1 else gray_of(rgb, kind)
                    mean, contrast, histogram = features_of(rgb, kind)
                    rows.append({"path": origin, "format": kind, "width": width, "height": height, **hashes_of(gray, kind), "mean_brightness": mean, "contrast": contrast, "histogram": histogram, "error": None})
            schema = pa.schema([("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), *[(h, pa.int64()) for h in HASHES], ("mean_brightness", pa.float32()), ("contrast", pa.float32()), ("histogram", pa.list_(pa.float32())), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    made = flat.mapInArrow(run, DECODED)
    roots = [paths] if isinstance(paths, str) else paths
    if all(p.startswith(("/", "file:")) for p in roots):
        return made
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    known = content.select(F.col("path").alias("_path"), format_of(F.col("content")).alias("_format"))
    return made.join(known, F.col("path") == F.col("_path"), "left").where("format IS NULL OR format = coalesce(_format, 'jpeg')").select(*made.columns)


def decoded(images: DataFrame) -> DataFrame:
    return images.where(F.col("error").isNull())


def failed(images: DataFrame) -> DataFrame:
    return images.where(F.col("error").isNotNull()).select("path", F.col("error").alias("message"))
