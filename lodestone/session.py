"""Session building and durable cut points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"lodestone-checkpoints-{os.getpid()}"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that later plans read it and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_by(df: DataFrame, col: str, parts: int) -> DataFrame:
    """``df`` written once like ``durable``, partitioned by ``col`` so that later joins by it move only the other side.

    An adaptive plan forgets how its rows lie, so this one plan is made without.
    """
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return durable(df.repartition(parts, col))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)
