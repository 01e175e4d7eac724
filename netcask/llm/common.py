"""Shared helpers: the cluster's shared folder, row checks, small codecs."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyarrow import fs as filesystem
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a local one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="netcask-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and any executor can read it. ``rows_per_file``: at most, 0 for no bound."""
    spark = df.sparkSession
    path = written_path(spark, label)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_shared(path: str):
    """A file of the shared folder, for Python workers: any store that Arrow opens by a URI."""
    store, name = filesystem.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return store.open_input_file(name)


def can_open_shared(spark: SparkSession) -> bool:
    """Whether Python can open the shared folder on this machine."""
    try:
        store, name = filesystem.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", shared_dir(spark)))
        return store.get_file_info(name).type == filesystem.FileType.Directory
    except (OSError, ValueError, ImportError):
        return False


def bucketed_table(df: DataFrame, label: str, buckets: int, column: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``column`` in the shared folder; ``drop_written`` takes it from the catalog."""
    spark = df.sparkSession
    name = f"nc_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", written_path(spark, label)).saveAsTable(name)
    _tables.append((spark, name))
    return spark.table(name)


def drop_written(spark: SparkSession | None = None) -> None:
    """Delete what ``materialize`` and ``bucketed_table`` wrote. Only for the end of a session: results read those files lazily."""
    while _tables:
        session, name = _tables.pop()
        with contextlib.suppress(Exception):
            session.sql(f"DROP TABLE IF EXISTS {name}")
    while _written:
        session, path = _written.pop()
        with contextlib.suppress(Exception):
            jvm = session.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(drop_written)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    name = f"_nc_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
