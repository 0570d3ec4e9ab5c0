"""Reading of the engine's Parquet tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Session setting: partitions a scan is spread over for work that is heavy a row. 0 leaves scans as they are; without it a scan with
#: fewer splits than there are cores is spread over the cores, at the price of shuffling the selected columns once.
SPREAD = "spark.lexitile.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame; columns and filters are pushed down by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; where none is set, a temporary one in local mode only: on a cluster every executor must reach it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexitile-"))


def spread(df: DataFrame) -> DataFrame:
    """A scan spread as ``SPREAD`` says; no result depends on it."""
    spark = df.sparkSession
    wanted = spark.conf.get(SPREAD, None)
    if wanted is not None:
        return df.repartition(int(wanted)) if int(wanted) > 0 else df
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
