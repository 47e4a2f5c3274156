"""Tables that operators write for themselves, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a folder of our own if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = shared_path.own = getattr(shared_path, "own", None) or tempfile.mkdtemp(prefix="quillstack-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out evenly, or by a hash of columns, to several tasks a core at least, which adaptive execution doesn't
    join again: for work that costs far more than the bytes of its rows tell."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)
