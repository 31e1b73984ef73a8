"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a local folder if the master is local (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quantgrid-checkpoints")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete path when the driver's JVM ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def new_table(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that materialize wrote and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder (a new_table) and read it back.

    The table outlives any executor. It is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = path or new_table(spark)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Nodes of a plan that take more than reading rows once more.
COSTLY = re.compile(r"\b(Aggregate|Join|Window|Sort|Distinct|Repartition\w*|Generate|Deduplicate|MapIn\w+|FlatMap\w+)\b")


def once(df: DataFrame) -> DataFrame:
    """df for several readers: as it is where its rows come straight from files, else written, so that it is computed once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return materialize(df) if COSTLY.search(plan) else df
