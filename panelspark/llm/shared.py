"""What several operators need: tables, shared scratch folders, bucket counts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir), in the folder that temporary() has made if one is open.

    Only a local session gets a temporary one where none is set.
    """
    root = _folder.get() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession, name: str) -> Iterator[None]:
    """What is written meanwhile goes into a folder of its own, which is removed at the end; so results must be written elsewhere by then."""
    path = scratch(spark, name)
    before = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(before)
        remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input (as stored) that a bucket of a grouped map stands for, and buckets that are made of the input's size at most.
BUCKET_BYTES, MOST_BUCKETS = 1 << 26, 1 << 14


def buckets(df: DataFrame, per_partition: int = 1, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Groups that grouped-map steps split the keys of df into: as many as shuffle partitions, which the user scales with
    the data, and more where the input is large, so that a group's memory doesn't grow with it.

    Not more than MOST_BUCKETS for the size alone, as a step from buckets to buckets sends up to their square in blocks.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // bucket_bytes), MOST_BUCKETS))
