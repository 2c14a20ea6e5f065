"""Session settings, and where intermediate results may be written."""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables: ``spark.checkpoint.dir``.

    Where the setting is absent, a session in this one process may use a folder of this machine: on a
    cluster another executor could not read it, so there it must be set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"tidegauge-{spark.sparkContext.applicationId}")
    return named


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scratch/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Write a step to the shared folder (at ``path``, a scratch path, if given) and read it back.

    For steps that several branches of a plan need: Spark would compute each branch's copy from the raw
    table. The written step also survives the loss of an executor.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one settled step of this application that no later job reads."""
    if not path.startswith(f"{_own(spark)}/"):
        raise ValueError(f"not a scratch path of this application: {path}")
    _delete(spark, path)


def sweep(spark: SparkSession) -> None:
    """Delete this application's scratch steps, once no result that reads them is in use."""
    _delete(spark, _own(spark))
