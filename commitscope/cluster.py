"""Makes this package importable in the Python workers of whatever cluster a session runs on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).parent
    archive = Path(tempfile.mkdtemp()) / "commitscope.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(top.rglob("*")):
            if path.is_file() and path.suffix in (".py", ".json"):
                z.write(path, path.relative_to(top.parent))
    context.addPyFile(os.fspath(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is set only where none is configured and all tasks run on this machine."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="commitscope-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the folder that the session names."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back; removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/view-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
