"""Altered copies of images, to make positive pairs: numpy kernels on RGB arrays.

Every transform is a kernel and the strengths it is drawn from. Which
transforms a base gets, and how strong, follow from hashes of its name, so a
run can be repeated and split over any number of tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions.signatures import HASHES
from echofold.sources import decode

GRAY = np.array(decode.LUMA)

# The example quantisation tables of the JPEG standard, for brightness and for colour.
LUMA_STEPS = np.array(
    """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
    18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99""".split(),
    float,
).reshape(8, 8)
COLOUR_STEPS = np.array(
    """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
    99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99""".split(),
    float,
).reshape(8, 8)
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
_FREQUENCIES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos(np.pi * (2 * x + 1) * k / 16) for x in range(8)] for k in range(8)])


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def scaled(image: np.ndarray, part: float) -> np.ndarray:
    h, w = image.shape[:2]
    return decode.resize(image, max(1, int(w * part)), max(1, int(h * part)))


def quantised(image: np.ndarray, quality: float) -> np.ndarray:
    """What a lossy round trip at a quality leaves: terms of 8 by 8 blocks rounded to steps."""
    h, w = image.shape[:2]
    scale = 50 / quality if quality < 50 else 2 - quality / 50
    padded = np.pad(image.astype(float), [(0, -h % 8), (0, -w % 8), (0, 0)], "edge") @ _TO_YCC.T
    padded[..., 0] -= 128
    for c, steps in enumerate((LUMA_STEPS, COLOUR_STEPS, COLOUR_STEPS)):
        step = np.maximum(1, np.floor(steps * scale + 0.5))
        rows, cols = padded.shape[0] // 8, padded.shape[1] // 8
        blocks = padded[..., c].reshape(rows, 8, cols, 8).transpose(0, 2, 1, 3)
        terms = np.rint((_FREQUENCIES @ blocks @ _FREQUENCIES.T) / step) * step
        padded[..., c] = (_FREQUENCIES.T @ terms @ _FREQUENCIES).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
    padded[..., 0] += 128
    return _clip((padded @ np.linalg.inv(_TO_YCC).T)[:h, :w])


def brighter(image: np.ndarray, factor: float) -> np.ndarray:
    return _clip(image * factor)


def more_contrast(image: np.ndarray, factor: float) -> np.ndarray:
    middle = np.rint((image @ GRAY).mean())
    return _clip(middle + (image - middle) * factor)


def more_colour(image: np.ndarray, factor: float) -> np.ndarray:
    gray = (image @ GRAY)[..., None]
    return _clip(gray + (image - gray) * factor)


def lossless(image: np.ndarray, _: float) -> np.ndarray:
    return image


def corner_bar(image: np.ndarray, shade: float) -> np.ndarray:
    """A dark bar over the left half of the lower edge."""
    out = image.copy()
    h, w = image.shape[:2]
    out[h - max(8, h // 12) :, : w // 2 + 1] = int(shade)
    return out


def top_banner(image: np.ndarray, shade: float) -> np.ndarray:
    """A bright banner over the upper quarter."""
    out = image.copy()
    out[: image.shape[0] // 4 + 1] = int(shade)
    return out


def blurred(image: np.ndarray, radius: float) -> np.ndarray:
    reach = int(3 * radius)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    out = image.astype(float)
    for axis in (0, 1):
        pads = [(reach, reach) if a == axis else (0, 0) for a in range(3)]
        wide = np.lib.stride_tricks.sliding_window_view(np.pad(out, pads, "edge"), 2 * reach + 1, axis)
        out = wide @ (weights / weights.sum())
    return _clip(out)


def tilted(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre, same size, black where nothing comes in."""
    h, w = image.shape[:2]
    angle = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w]
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sx = np.rint(np.cos(angle) * dx - np.sin(angle) * dy + (w - 1) / 2).astype(int)
    sy = np.rint(np.sin(angle) * dx + np.cos(angle) * dy + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.zeros_like(image)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def flipped(image: np.ndarray, _: float) -> np.ndarray:
    return np.ascontiguousarray(image[:, ::-1])


def cropped(image: np.ndarray, edge: float) -> np.ndarray:
    h, w = image.shape[:2]
    dy, dx = int(h * edge), int(w * edge)
    return np.ascontiguousarray(image[dy : h - dy, dx : w - dx])


#: Name, kernel and strengths. Crops are kept apart: hashes of whole images can't find them.
TRANSFORMS: dict[str, tuple[Callable[[np.ndarray, float], np.ndarray], tuple[float, ...]]] = {
    "quality70": (quantised, (70,)),
    "quality40": (quantised, (40,)),
    "resize50": (scaled, (0.5,)),
    "resize25": (scaled, (0.25,)),
    "brightness": (brighter, (0.75, 0.85, 1.15, 1.3)),
    "contrast": (more_contrast, (0.75, 0.85, 1.2, 1.4)),
    "saturation": (more_colour, (0.5, 0.7, 1.3, 1.6)),
    "topng": (lossless, (0,)),
    "watermark": (corner_bar, (20,)),
    "blur": (blurred, (2.0,)),
    "rotate": (tilted, (-6, -3, 3, 6)),
    "overlay_large": (top_banner, (240,)),
    "flip": (flipped, (0,)),
}
CROPS = {"crop15": (cropped, (0.15,)), "crop25": (cropped, (0.25,))}


def chosen(base: str, k: int, seed: int = 42) -> list[tuple[str, float]]:
    """k transforms of a base image and their strengths."""
    place = lambda *x: zlib.crc32("|".join(map(str, (seed, base, *x))).encode())
    names = sorted(TRANSFORMS, key=lambda n: (place(n), n))[:k]
    return [(n, TRANSFORMS[n][1][place(n, "strength") % len(TRANSFORMS[n][1])]) for n in names]


DERIVED = "base string, transform string, width int, height int, " + ", ".join(f"{h} long" for h in HASHES)


def derive(images: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Signatures of each image (base, width, height, rgb) as it is and after k transforms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("base", pa.string()), ("transform", pa.string()), ("width", pa.int32()), ("height", pa.int32()), *[(h, pa.int64()) for h in HASHES]])
        for batch in batches:
            rows = []
            for base, width, height, rgb in zip(*(batch.column(c).to_pylist() for c in range(4))):
                image = np.frombuffer(rgb, np.uint8).reshape(height, width, 3)
                for name, strength in [("original", 0.0), *chosen(base, k, seed)]:
                    made = image if name == "original" else TRANSFORMS[name][0](image, strength)
                    rows.append({"base": base, "transform": name, "width": made.shape[1], "height": made.shape[0], **decode.hashes_of(_clip(made @ GRAY))})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return images.select(F.col("base").cast("string"), F.col("width").cast("int"), F.col("height").cast("int"), "rgb").mapInArrow(run, DERIVED)
