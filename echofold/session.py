"""Session helpers. A caller's session is used as it is; nothing here changes its settings."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "echofold", shuffle: int | None = None) -> SparkSession:
    """A session for tests, the command line and the bench; a cluster brings its own."""
    n = shuffle or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", os.environ.get("ECHOFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all machines share.

    The folder is the one named by spark.checkpoint.dir. Where that is unset, a
    session of one machine takes a local folder; on a cluster that is an error,
    as its machines would each see another. What an application writes is
    deleted when its process ends.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.gettempdir() + "/echofold-shared"
    own = f"{top.rstrip('/')}/echofold/{context.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_remove_at_end, spark, own)
    return f"{own}/{kind}-{uuid.uuid4().hex}"


_folders: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any store that the session can reach."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_end(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be closed: then the folder stays
        pass


def written(df: DataFrame, kind: str) -> DataFrame:
    """df written as a table in the shared folder and read again: this cuts the lineage.

    A lost executor then costs only its running tasks, never the steps before.
    """
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
