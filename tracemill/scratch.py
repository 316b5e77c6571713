"""Tables that an operator writes on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="tracemill-"))
    return folder.rstrip("/")


def place(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{root(spark)}/tracemill/{tag}-{uuid.uuid4().hex}"


def write(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: later plans read the same rows, whatever the plan of df would give another time."""
    path = place(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
