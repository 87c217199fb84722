"""Tables written in the shared scratch folder, so that what is used more than once is made once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_scratch: str | None = None
_settled: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in
    local mode, and an error on a cluster."""
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_scratch is None:
        _own_scratch = "file://" + tempfile.mkdtemp(prefix="veridoc-")
    return _own_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: lineage ends there, and the
    rows stay the same however often they are read and whichever executors are lost."""
    path = scratch_path(df.sparkSession, label)
    _settled.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a settled table that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all settled tables of this process, once no result that reads them is needed."""
    while _settled:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_settled.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
