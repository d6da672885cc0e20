"""Session construction and durable cut points shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "twinsift", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset in a local session.

    On a cluster the setting is required: a folder of one machine would not survive it, nor be seen by the others.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = os.path.join(tempfile.gettempdir(), f"twinsift-{os.getuid()}-{os.getpid()}")
    os.makedirs(fallback, exist_ok=True)
    return f"file://{fallback}"


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs nothing that was written here. ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, frame: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        frame.write.mode("overwrite").parquet(path)
        table = self.spark.read.schema(frame.schema).parquet(path)
        table._twinsift_path = path  # type: ignore[attr-defined]
        return table

    def drop(self, table: DataFrame) -> None:
        path = getattr(table, "_twinsift_path", None)
        if path is None:
            return
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
