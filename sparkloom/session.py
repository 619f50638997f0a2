"""Session settings the engine expects, and the catalogue of input tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def builder(app: str = "sparkloom") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in ``spark.checkpoint.dir``; one of our own only where one machine runs all."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="sparkloom-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; a missing one stops at once, never as an empty relation."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
