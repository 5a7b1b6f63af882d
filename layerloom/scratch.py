"""Tables in the shared scratch folder, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; where that is unset, a session on one machine gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
        base = _local[context.applicationId]
    return f"{base.rstrip('/')}/layerloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared scratch folder and read again."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
