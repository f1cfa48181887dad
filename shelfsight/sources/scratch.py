"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, on one machine only, that goes when Python ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def drop_written(spark: SparkSession) -> None:
    """Remove all intermediate tables under the scratch folder. Results that were not read yet are lost with them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/shelfsight")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: lineage ends here, and lost executors lose nothing."""
    path = f"{scratch_dir(df.sparkSession)}/shelfsight/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
