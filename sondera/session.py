"""Session helpers: building a local session, tables in the shared folder, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", name: str = "sondera") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one serves a session on one
    machine; on a cluster that is an error, since executors would not see one another's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sondera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    path = new_folder(spark, name)
    _file_system(spark, path).deleteOnExit(_hadoop_path(spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors. What discard() has not
    deleted by then goes when the application ends."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sondera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by materialise() that no later plan reads."""
    for t in tables:
        delete_folder(t.sparkSession, t._sondera_path)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(_hadoop_path(spark, path), True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder; none where there is no such folder."""
    fs, at = _file_system(spark, path), _hadoop_path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def file_exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_hadoop_path(spark, path))


def folder_stamp(spark: SparkSession, path: str) -> tuple:
    """Sizes and times of the files at a path: what tells whether a table has been rewritten."""
    fs, at = _file_system(spark, path), _hadoop_path(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def create_new_file(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False where there is one already."""
    fs, at = _file_system(spark, path), _hadoop_path(spark, path)
    return fs.createNewFile(at)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of a name that Spark's writers cannot give, in any store that Spark reaches."""
    out = _file_system(spark, path).create(_hadoop_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the Python workers, once per context, so that functions run in them can import it
    wherever the executors are."""
    sc = spark.sparkContext
    if getattr(sc, "_sondera_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    target = os.path.join(tempfile.mkdtemp(prefix="sondera-"), f"sondera-{digest}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in files:
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    sc._sondera_shipped = True


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with this package importable in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
