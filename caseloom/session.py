"""Session defaults, and tables stored in between in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

def build_session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Sizes (memory, shuffle partitions) stay with the cluster unless passed in.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # longer generated methods are not compiled to machine code by the JVM
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, as a URI.

    All executors see it. Only a local master, where driver and tasks share one
    disk, falls back to a temporary folder when the setting is absent. What lies
    in the folder is removed when the driver's Python ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="caseloom-")
            atexit.register(_remove, f"file://{base}")
        base = base if "://" in base or base.startswith("file:") else f"file://{base}"
        _FOLDERS[context.applicationId] = f"{base.rstrip('/')}/caseloom-{context.applicationId}"
        atexit.register(_remove, _FOLDERS[context.applicationId])
    return _FOLDERS[context.applicationId]


def _remove(folder: str) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused name below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there.

    Cuts the lineage like a checkpoint, but keeps column pruning, filters and
    size statistics for what follows.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def stored_meanwhile(df: DataFrame, name: str = "table") -> Iterator[DataFrame]:
    """``stored`` for a large table that nothing reads after the ``with`` block: small files, then removed."""
    folder, spark = new_folder(df.sparkSession, name), df.sparkSession
    try:
        df.write.option("compression", "zstd").parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
