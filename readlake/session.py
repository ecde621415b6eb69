"""A session with the settings that the engine counts on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **more: str) -> SparkSession:
    """partitions: of shuffles before adaptive execution coalesces them; the cluster's own setting if none is given."""
    builder = SparkSession.builder.master(master).appName("readlake")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a temporary one of our own only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="readlake-")


def keep(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: state that several steps of a round read is computed once and survives executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it too, besides their own path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in (known := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
