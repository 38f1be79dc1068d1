"""Session builder with the settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # GBK and its kin in CSV files
}


def session(name: str = "tablesmith", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with DEFAULTS; conf wins. Without a master from spark-submit it
    is local, on SPARK_CPUS or all cores."""
    builder = SparkSession.builder.appName(name)
    if "SPARK_MASTER" not in os.environ and "MASTER" not in os.environ:
        builder = builder.master(f"local[{os.environ.get('SPARK_CPUS', '*')}]")
    spark = builder.config(map=DEFAULTS | (conf or {})).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def java_charsets(spark: SparkSession) -> None:
    """Lets a session of any builder read and write GBK and its kin."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def package_on_workers(spark: SparkSession) -> None:
    """Python workers of a local session find this package beside its own path. On
    a cluster it is shipped with spark-submit --py-files."""
    if spark.sparkContext.master.startswith("local"):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a
    local session without that setting gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tablesmith-"))
    return spark.conf.get("spark.checkpoint.dir")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its rows are computed once, and stay what they were."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
