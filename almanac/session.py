"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_base: dict[str, str] = {}


def build_session(app: str = "almanac", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    UTC keeps calendar fields independent of the machine; AQE picks join strategies
    and partition counts from measured sizes.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the Python call site of every column costs more than planning wide frames.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach, for tables written mid-job.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    session, where driver and executors are one machine, may fall back to a
    temporary folder, which goes when the program ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        app_id = spark.sparkContext.applicationId
        if app_id not in _local_base:
            _local_base[app_id] = tempfile.mkdtemp(prefix="almanac-")
            atexit.register(shutil.rmtree, _local_base[app_id], ignore_errors=True)
        base = _local_base[app_id]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give the session a checkpoint folder when it has none (boosted trees cut lineage there)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
