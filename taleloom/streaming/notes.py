"""Streams of note changes: last write wins, written as snapshots at a pace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from taleloom.operators.notes import newest_version
from taleloom.sources.vault import SnapshotStore

#: How long changes gather before they are saved.
DEBOUNCE = "500 milliseconds"


def changes(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merged(state: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key of both; the order in which batches come does not matter."""
    return newest_version(state.unionByName(batch), key, version)


def upsert(stream: DataFrame, store: SnapshotStore, name: str, key: str, version: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the table `name` in the store at the last write of each key. A batch that is run again gives the same
    table, so a restart from the checkpoint loses and repeats nothing."""
    schema = stream.schema

    def save(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.save({name: merged(store.load(name, schema), newest_version(batch, key, version), key, version)})

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    start().awaitTermination()
