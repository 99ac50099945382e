"""The shared folder for intermediate tables, and tables that queries of a session share there."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemora.sources.vault import _hadoop, exists


def root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Without one, a local session makes its own; elsewhere that is an error, as no other machine sees it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='mnemora-')}"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may have gone first
        pass


def stamp(spark: SparkSession, path: str) -> str:
    """Names a file or folder as it is now: its path, newest change and size."""
    fs, p = _hadoop(spark, path)
    newest, files = 0, fs.listStatus(p)
    for f in files:
        newest = max(newest, f.getModificationTime())
    return hashlib.sha256(f"{path} {newest} {fs.getContentSummary(p).getLength()}".encode()).hexdigest()[:24]


def shared(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from ``source``: written at first use, read by later queries while the source is as it was."""
    path = f"{root(spark)}/mnemora-{name}-{stamp(spark, source)}-{spark.sparkContext.applicationId}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
        atexit.register(remove, spark, path)
    return spark.read.parquet(path)


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: made once however often it is used, and not again if an executor is lost."""
    spark = df.sparkSession
    path = f"{root(spark)}/mnemora-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.parquet(path)
