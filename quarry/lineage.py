"""Cutting a plan's lineage by a checkpoint in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process, as in tests, a new temporary folder."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not conf and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return conf or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows dealt anew by columns: a small file is read as one task, however much is worked out for each of its rows."""
    return df.repartition(*by)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """As spread(), for rows that are small themselves: as many tasks as shuffles have, which adaptive execution doesn't put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def read_once(df: DataFrame, column: str, name: str, read: Callable[[Column], Column]) -> DataFrame:
    """df with read(column) as a new column, worked out once for each different value; for values that rows share and that are slow to read."""
    values = df.select(F.col(column).alias("_value")).distinct().select("_value", read(F.col("_value")).alias(name))
    return df.join(values, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")
