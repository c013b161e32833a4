"""Session helpers: where lineage is cut, and small tables made of driver-side results."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. A temporary one is set only in local mode, where there is one machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="rankfold-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read back: computed once, and safe if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few result rows as a DataFrame. Arrow hands them over without starting Python workers."""
    fields = [field.split() for field in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(column), _ARROW[kind]) for column, (_, kind) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))
