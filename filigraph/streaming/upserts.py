"""Upserts of a stream of node rows into a Parquet table, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from filigraph.operators.mutate import merge_nodes
from filigraph.sources.files import latest_path


def upsert_stream(rows: DataFrame, folder: str, key: str, order: Column, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch of ``rows`` into the newest version of the table under ``folder``.

    A batch writes version ``v_<batch>``; a batch that is run again writes the same version again, so the result does
    not depend on restarts. The first batch starts from nothing. The query processes what is there and stops.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"v_{number:012}"
        old = latest_path(spark, folder, "v_", below=name)  # a batch that runs again starts from the version before it
        base = spark.read.parquet(old) if old else batch.limit(0)
        merge_nodes(base, batch, key, order).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/{name}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """The table as of the last batch."""
    return spark.read.parquet(latest_path(spark, folder, "v_"))
