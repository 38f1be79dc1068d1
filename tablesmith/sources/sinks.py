"""Sinks: Parquet tables, in-place replacement, an upsert log."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.functions.scalars import redacted_table
from tablesmith.operators.cleaning import ORDER, named


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.drop(ORDER).write.mode(mode).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes over a table that df may read: to a new folder first, then swapped.
    Spark can't overwrite what it reads."""
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    save(df, new)
    jvm = spark.sparkContext._jvm
    old_path, new_path = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = old_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{new}.old")
    if fs.exists(old_path):
        fs.rename(old_path, aside)
    fs.rename(new_path, old_path)
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def append_log(df: DataFrame, path: str) -> None:
    save(df, path, "append")


def save_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Named arrays of numbers as rows (name, shape, values)."""
    rows = [(n, list(a.shape), a.astype(float).ravel().tolist()) for n, a in arrays.items()]
    save(spark.createDataFrame(rows, "name string, shape array<int>, values array<double>"), path)


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def append_events(df: DataFrame, path: str) -> None:
    """Adds events to a log of JSON lines; sensitive values are masked at any depth."""
    redacted_table(df.drop(ORDER)).write.mode("append").json(path)


def latest(log: DataFrame, key: str, updated: str) -> DataFrame:
    """The newest row of each key: an append-only log read as an upserted table. Of
    rows of the same time the one with the largest other values wins."""
    rest = [F.to_json(F.struct(*[named(c) for c in log.columns]))]
    newest = Window.partitionBy(key).orderBy(F.col(updated).desc(), *[x.desc() for x in rest])
    return log.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
