"""Readers of dataset folders, shards, text logs and configurations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jsonl

#: A split is a folder or file named like it; these endings are read.
FORMATS = {".parquet": "parquet", ".jsonl": "json", ".json": "json"}


def splits(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The splits of a dataset folder by name: train.parquet, test.jsonl and so on (files, or folders of part files)."""
    found = {}
    if not (there := jsonl.entries(spark, folder)):
        raise FileNotFoundError(folder)
    for name, path in sorted(there.items()):
        stem, _, ending = name.rpartition(".")
        if kind := FORMATS.get(f".{ending}"):
            found[stem] = spark.read.format(kind).load(path)
    return found


def shards(spark: SparkSession, paths: list[str], schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """The rows of all shards that are there, and a table (path) of those that aren't: a missing shard is recorded, not fatal."""
    there = [p for p in paths if jsonl._exists(spark, p)]
    gone = spark.createDataFrame([(p,) for p in paths if p not in there], "path string")
    rows = jsonl.read(spark, there, schema, **options) if there else jsonl.read(spark, paths, schema, missing_ok=True, **options)
    return rows, gone


def log_text(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): whole log files; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("place"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML configuration; an empty file is an empty one, and anything but a mapping is an error."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    if path.endswith(".json"):
        found = json.loads(text or "{}")
    else:
        import yaml

        found = yaml.safe_load(text)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found or {}
