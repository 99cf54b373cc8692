"""Helpers shared by the operators of this subpackage.

Spark hands Arrow batches of bounded bytes to Python workers
(spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set), so no operator changes
the session for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import broadcast_if_small, scratch, shared_dir, written

__all__ = ["broadcast_if_small", "scratch", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
