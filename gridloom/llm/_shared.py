"""Scratch tables in the folder that the whole cluster shares, and table access."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and runs on one machine (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor and the driver can reach. A cluster without one is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return context.getCheckpointDir().get().rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that Spark takes it to lie on."""
    p, fs = _path(spark, path)
    return re.sub(r"^file:/+", "file:///", fs.makeQualified(p).toString())


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables that materialise() made, once nothing reads them any more."""
    for df in tables:
        for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/gridloom-" in p:
                path, fs = _path(spark, p)
                fs.delete(path, True)
