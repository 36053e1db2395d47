"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the session's spark.checkpoint.dir. A
    temporary one is made only where that is unset and all runs on one machine; elsewhere that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once, so that later reads neither recompute it nor depend on
    the executors that made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def give_back() -> None:
    """Returns memory that a task no longer uses to the machine: Python workers live on, and what their allocators keep would stand
    beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Has the session hand rows to Python in batches of so many bytes at most (64 MB otherwise), as many texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([bkmg]?).*", spark.conf.get(name).lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) > most:
        spark.conf.set(name, f"{most}b")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
