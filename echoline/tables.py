"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that the driver and all executors share; a local one only where none is set,
    as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT, None) or context.getConf().get(CHECKPOINT)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="echoline-")
        folder = _own[context.applicationId]
    return f"{folder.rstrip('/')}/echoline-{context.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read again: what several branches of a plan use is computed once and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
