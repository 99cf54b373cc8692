"""Relations of records that arrive file by file, appended without repetition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("source", "target", "type", "season")

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_relations(relations: DataFrame) -> DataFrame:
    """Of a stream of relations those whose keys did not come before, each with the least
    row_no of its first batch; a missing season equals a missing season. Keys that were seen
    are in the state store, by their hash in as many parts as the session has shuffle
    partitions when the stream first starts, with the times of the first and the last batch
    that had them: a key is new where these are one. A batch that runs again keeps its time."""
    timed = relations.withColumn("_now", F.current_timestamp())
    seen = timed.groupBy(*KEYS).agg(F.min("row_no").alias("row_no"), F.min("_now").alias("_first"), F.max("_now").alias("_last"))
    return seen.filter("_first = _last").drop("_first", "_last")


def append_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """Writes a batch as a part of its own that its number names: a batch that runs again
    after a failure writes over its part and leaves the others alone."""
    batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def append_relations_stream(
    spark: SparkSession, source: str, schema: str, to_relations: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, files_per_batch: int = 100
) -> StreamingQuery:
    """Reads JSON records that arrive in the folder `source`, turns them row by row into
    (source, target, type, season, row_no) and appends to `table` what is new. Of equal
    relations in one batch that with the least row_no stays.

    What was read and which keys were seen is in the checkpoint, the keys in a RocksDB state
    store on the executors' disks, so a batch costs what it holds, however large the table
    is: the table is never read. A restart resumes after the last batch that ended.
    """
    records = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    writer = new_relations(to_relations(records)).writeStream.outputMode("update").foreachBatch(lambda batch, n: append_batch(batch, n, table))
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps what the session has when it starts
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
