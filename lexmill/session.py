"""Spark session with the settings the engine is tested under."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the folder of spark.checkpoint.dir and read it back.

    A temporary folder of our own stands in only where it is unset on one machine.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/lexmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores where it has fewer tasks than the cluster has cores, as one small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it on their path."""
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    name = f"{root.name}-{hashlib.sha256(held.getvalue()).hexdigest()[:16]}.zip"
    key = f"{spark.sparkContext.applicationId}/{name}"
    if key not in _SHIPPED:
        path = os.path.join(tempfile.mkdtemp(prefix=f"{root.name}-"), name)
        Path(path).write_bytes(held.getvalue())
        spark.sparkContext.addPyFile(path)  # the driver serves it to the executors
        _SHIPPED.add(key)
