"""File scans: formats by content, errors as rows, and the manifests of labelled pairs."""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The first bytes of the two formats.
JPEG_MAGIC, PNG_MAGIC = b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n"
EXTENSIONS = (".jpg", ".jpeg", ".png")

MANIFEST = "path_a string, path_b string, label int, transform string, split string, base_a string, base_b string"


def format_of(content: Column) -> Column:
    """jpeg, png or null, from the first eight bytes of BINARY."""
    head = F.substring(content, 1, 8)
    jpeg = F.substring(head, 1, 3) == F.lit(JPEG_MAGIC)
    return F.when(jpeg, "jpeg").when(head == F.lit(PNG_MAGIC), "png")


def extension_mismatch(path: Column) -> Column:
    """Whether the extension is none of an image's; which image format it names doesn't matter."""
    return ~F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)


def inventory(files: DataFrame, min_size: int = 1) -> DataFrame:
    """Images among files (file_id, path, content): size, format and extension_mismatch."""
    sized = files.withColumn("size_bytes", F.octet_length("content").cast("long")).where(F.col("size_bytes") >= min_size)
    return sized.withColumn("format", format_of(F.col("content"))).where("format IS NOT NULL").withColumn("extension_mismatch", extension_mismatch(F.col("path")))


def skipped(files: DataFrame, min_size: int = 1) -> DataFrame:
    """Files large enough that are no images."""
    sized = files.withColumn("size_bytes", F.octet_length("content").cast("long")).where(F.col("size_bytes") >= min_size)
    return sized.where(format_of(F.col("content")).isNull())


def read_binary(spark: SparkSession, roots: list[str], min_size: int = 1) -> DataFrame:
    """The fast scan, by Spark's own reader: path, size_bytes, mtime, content.

    The size bound is pushed into the listing. Names that begin with '_' or '.'
    are left out by Spark, and folders that can't be read are not reported;
    scan() has both.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return raw.where(F.col("length") >= min_size).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")


SCAN_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),  # image, skipped, entry or error
        T.StructField("path", T.StringType(), False),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("format", T.StringType()),
        T.StructField("extension_mismatch", T.BooleanType()),
        T.StructField("message", T.StringType()),
    ]
)


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


#: Folders that the driver looks into, level by level, before the rest is left to tasks.
LISTED = 256


class ScanReader(DataSourceReader):
    """One partition for each folder's own files as far as folders were listed, one for all below each other folder.

    The driver lists at most LISTED folders, so a deep or wide tree makes many
    tasks and a flat one few.
    """

    def __init__(self, options: dict) -> None:
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.min_size = int(options.get("minsize", 1))
        self.follow = str(options.get("followsymlinks", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        todo = deque(self.roots)
        while todo and len(found) < LISTED:
            folder = todo.popleft()
            found.append(_Folder(folder, False))
            try:
                todo += [e.path for e in sorted(os.scandir(folder), key=lambda e: e.name) if e.is_dir(follow_symlinks=self.follow)]
            except OSError:
                pass
        return found + [_Folder(path, True) for path in todo] or [_Folder("", False)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not partition.path:
            return
        if not os.path.isdir(partition.path):
            yield ("error", partition.path, None, None, None, None, "not a readable directory")
            return
        roots = set(self.roots)
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except PermissionError:
                if folder in roots:
                    yield ("error", folder, None, None, None, None, "not a readable directory")
                continue
            except OSError as e:
                yield ("error", folder, None, None, None, None, str(e))
                continue
            for e in entries:
                yield from self._entry(e)
                if partition.deep and e.is_dir(follow_symlinks=self.follow):
                    todo.append(e.path)

    def _entry(self, entry: os.DirEntry) -> Iterator[tuple]:
        yield ("entry", entry.path, None, None, None, None, None)
        try:
            info = entry.stat()
        except OSError as e:
            yield ("error", entry.path, None, None, None, None, str(e))
            return
        if not stat.S_ISREG(info.st_mode) or info.st_size < self.min_size:
            return
        when = datetime.fromtimestamp(info.st_mtime, timezone.utc)
        try:
            kind = sniff(entry.path)
        except OSError as e:
            yield ("error", entry.path, None, None, None, None, str(e))
            return
        if kind is None:
            yield ("skipped", entry.path, info.st_size, when, None, None, None)
            return
        odd = os.path.splitext(entry.name)[1].lower() not in EXTENSIONS
        yield ("image", entry.path, info.st_size, when, kind, odd, None)


def sniff(path: str) -> str | None:
    """The format of one file by its first bytes."""
    with open(path, "rb") as f:
        head = f.read(8)
    return "jpeg" if head.startswith(JPEG_MAGIC) else "png" if head == PNG_MAGIC else None


def detect_image_format(path: str) -> str:
    """The format of a named file; what is no image is an error."""
    found = sniff(path)
    if found is None:
        raise ValueError(f"{path}: not a JPEG or PNG")
    return found


class ScanSource(DataSource):
    """spark.read.format("echofold_scan"): options roots (one a line), minSize, followSymlinks."""

    @classmethod
    def name(cls) -> str:
        return "echofold_scan"

    def schema(self) -> T.StructType:
        return SCAN_SCHEMA

    def reader(self, schema: T.StructType) -> ScanReader:
        return ScanReader(dict(self.options))


def scan(spark: SparkSession, roots: list[str], min_size: int = 1, follow_symlinks: bool = False) -> DataFrame:
    """Every entry below the roots, as SCAN_SCHEMA says; only the first bytes of files are read."""
    spark.dataSource.register(ScanSource)
    return spark.read.format("echofold_scan").option("roots", "\n".join(roots)).option("minSize", min_size).option("followSymlinks", follow_symlinks).load()


def scan_metrics(scanned: DataFrame) -> DataFrame:
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return scanned.agg(is_("entry").alias("entries_visited"), is_("image").alias("images_found"), is_("skipped").alias("skipped_non_image"), is_("error").alias("errors"), F.count_if(F.col("format") == "jpeg").alias("jpeg"), F.count_if(F.col("format") == "png").alias("png"), F.count_if("extension_mismatch").alias("mismatches"), F.coalesce(F.sum(F.when(F.col("kind") == "image", F.col("size_bytes"))), F.lit(0)).cast("long").alias("total_bytes"))


def read_manifest(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Labelled pairs from CSV with a header; short and malformed lines are dropped."""
    rows = spark.read.schema(MANIFEST).option("header", True).option("mode", "DROPMALFORMED").csv(path).where("base_b IS NOT NULL")
    return rows.limit(limit) if limit else rows


def manifest_images(manifest: DataFrame) -> DataFrame:
    """Each path of a manifest once."""
    return manifest.select(F.explode(F.array("path_a", "path_b")).alias("path")).distinct()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The groups of a report, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("groups").alias("g")).select("g.*")


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).csv(path)
