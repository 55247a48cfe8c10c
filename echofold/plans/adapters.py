"""The engine's relations made from the test tables, which hold no image files.

Documents become files whose first bytes depend on their content, embeddings
become 8 by 8 gray images with derived colours and sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import features as f
from echofold.functions.signatures import signatures
from echofold.operators import matching, scoring
from echofold.session import shared_dir
from echofold.sources.files import JPEG_MAGIC, PNG_MAGIC

SUFFIX_BY_ID = (".jpg", ".png", ".jpeg", ".dat", ".txt")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, content): the text's length by three chooses JPEG, PNG or no image."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    magic = F.element_at(F.array(F.lit(JPEG_MAGIC), F.lit(PNG_MAGIC), F.lit(b"")), (F.octet_length(text) % 3 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, SUFFIX_BY_ID)), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.concat(magic, text).alias("content"))


def local_folder(path: str) -> str:
    """The path of a shared folder as workers open it; they can't write files to other stores."""
    if not path.startswith(("file:", "/")):
        raise ValueError(f"{path}: files are made in a folder that all machines mount")
    return "/" + path.removeprefix("file:").lstrip("/")


def write_files(rows: DataFrame, folder: str) -> None:
    """Rows (name, content) as files in a folder that all machines mount."""
    import os

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                path = os.path.join(folder, name.as_py())
                os.makedirs(os.path.dirname(path), exist_ok=True)
                draft = f"{path}.{os.getpid()}"
                with open(draft, "wb") as out:
                    out.write(content.as_py())
                os.replace(draft, path)  # a task that runs twice leaves one file
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("name", "content").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    """The files of files() in a folder of their own, a hundred to a subfolder."""
    folder = local_folder(shared_dir(spark, "files"))
    made = files(spark, sf_dir)
    write_files(made.select(F.concat(F.floor(F.col("file_id") / 100).cast("string"), F.lit("/"), F.substring_index("path", "/", -1)).alias("name"), "content"), folder)
    return folder


def png_tree(spark: SparkSession, sf_dir: str, side: int = 9) -> str:
    """pictures() as PNG files; each fifth is called .dat, each seventh .jpg."""
    import zlib

    import numpy as np
    import pyarrow as pa

    def chunk(kind: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    def run(batches):
        for batch in batches:
            names, contents = [], []
            for base, width, height, rgb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows = np.frombuffer(rgb, np.uint8).reshape(height, 3 * width)
                raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()
                head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
                suffix = "dat" if int(base) % 5 == 0 else "jpg" if int(base) % 7 == 0 else "png"
                names.append(f"{int(base) // 100}/{base}.{suffix}")
                contents.append(PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b""))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], names=["name", "content"])

    folder = local_folder(shared_dir(spark, "pictures"))
    write_files(pictures(spark, sf_dir, side).mapInArrow(run, "name string, content binary"), folder)
    return folder


def sized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size_bytes", F.octet_length("content").cast("long"))


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, px): gray levels of the 64 components."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))).cast("int")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", level).alias("px"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(thumbnails(spark, sf_dir)).drop("px")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and colour features; green and blue are the gray levels moved on by 21 and 42 places."""
    moved = lambda k: F.concat(F.slice("px", k + 1, 64 - k), F.slice("px", 1, k)) if k else F.col("px")
    rows = thumbnails(spark, sf_dir).select("id", "label", F.col("px").alias("r"), moved(21).alias("g"), moved(42).alias("b"))
    rows = rows.withColumn("luma", f.luma(F.col("r"), F.col("g"), F.col("b"), 64)).withColumn("histogram", f.histogram(F.col("r"), F.col("g"), F.col("b"), 64))
    number = lambda base, step, span: (F.lit(base) + F.col("id") * step % span).cast("int")
    return rows.select(
        "id", "label", number(200, 37, 800).alias("width"), number(150, 53, 600).alias("height"), number(1000, 7919, 90000).cast("long").alias("file_size"),
        f.mean_of(F.col("luma")).cast("float").alias("mean_brightness"), f.contrast_of(F.col("luma")).cast("float").alias("contrast"), "histogram",
        F.concat(F.lit("vec/"), F.col("id").cast("string")).alias("path"), F.lit("png").alias("format"),
    )


def pairs(spark: SparkSession, sf_dir: str, radii: dict[str, int] | None = None) -> DataFrame:
    blocks = matching.blocks_for(read(spark, sf_dir, "embeddings").count())  # counted before anything is hashed
    return matching.candidates(hashed(spark, sf_dir), radii, blocks)


def scored(spark: SparkSession, sf_dir: str, model: scoring.Classifier | None = None) -> DataFrame:
    return scoring.score(scoring.pair_features(pairs(spark, sf_dir), images(spark, sf_dir)), model or scoring.Classifier.shipped())


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs with label 1 where both images have one label, and their places in the splits."""
    of = lambda c: read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(c), F.col("label").alias(f"label_{c}"))
    rows = scored(spark, sf_dir).join(of("a"), "a").join(of("b"), "b")
    return rows.withColumn("label", (F.col("label_a") == F.col("label_b")).cast("int"))


def pictures(spark: SparkSession, sf_dir: str, side: int = 9) -> DataFrame:
    """(base, width, height, rgb): images of 8 by 8 cells of `side` pixels, coloured as in images()."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            px = batch.column("px").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64).astype(np.uint8)
            colours = np.stack([px, np.roll(px, -21, 1), np.roll(px, -42, 1)], 2).reshape(-1, 8, 8, 3)
            whole = colours.repeat(side, 1).repeat(side, 2)
            n = pa.array([8 * side] * len(px), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), n, n, pa.array([x.tobytes() for x in whole], pa.binary())], names=["base", "width", "height", "rgb"])

    return thumbnails(spark, sf_dir).select("id", "px").mapInArrow(run, "base string, width int, height int, rgb binary")
