"""A Spark session with the settings that the engine's plans assume."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    A local session that names none gets one in its warehouse; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"
