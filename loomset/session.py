"""Session helpers: where reliable checkpoints go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without that setting
    gets a fresh temporary folder; on a cluster a missing setting is an error, because a folder on
    one machine would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="loomset-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    This drops the lineage (between rounds of iterative plans, or before several readers) and survives the
    loss of executors. Unlike a row checkpoint it is columnar, so readers prune columns and the planner knows
    the size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/loomset-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
