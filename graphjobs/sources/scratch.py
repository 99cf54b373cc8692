"""Tables that jobs keep between their steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that the session was given. Only on
    a local master, as in tests, one is made where there is none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: Paths given out in this process, for clear().
_given: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this process wrote here, once no DataFrame needs them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _given:
        path = jvm.org.apache.hadoop.fs.Path(_given.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: later jobs read it instead of computing
    them again, also after executors were lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A hint to broadcast, after a look at the number of (short) rows; where there are
    more, the join is left to be shuffled, with skewed parts split at run time."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
