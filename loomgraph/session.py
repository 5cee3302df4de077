"""Session helpers shared by all operators: table access and lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder from spark.checkpoint.dir; a temporary folder only where that is unset and the session runs in one process (tests).

    Raises on a cluster without that setting, where a folder of one machine would lose data. The cleaner deletes checkpoints that are no longer in use.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir names no shared folder; set it on a cluster")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomgraph-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
