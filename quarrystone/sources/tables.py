"""Parquet scans by table name, and where cut lineage goes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table `name` of a data folder, pruned to `columns` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder of spark.checkpoint.dir.

    Only where neither the setting nor the context names a folder, in a local session such as a test's, one is made;
    a cluster without a shared folder is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarrystone-"))
    return df.checkpoint(eager)
