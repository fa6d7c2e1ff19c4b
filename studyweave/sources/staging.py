"""Tables between the steps of iterative plans, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Where tables go on a single machine whose session names no shared folder.
LOCAL = "/tmp/checkpoints/studyweave"

_scratch: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below this application's folder in spark.checkpoint.dir; a cluster must have that set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = f"{(base or LOCAL).rstrip('/')}/steps-{spark.sparkContext.applicationId}"
    _scratch[top] = spark
    return f"{top}/{tag}-{uuid4().hex}"


@atexit.register
def release() -> None:
    """Delete the tables of all steps of this process; results that still read them must have been written before."""
    while _scratch:
        top, spark = _scratch.popitem()
        if spark.sparkContext._jsc is not None:  # not stopped
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
