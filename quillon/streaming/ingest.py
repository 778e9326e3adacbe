"""Appending records to an index as a stream: tokens are row-local, so a micro-batch is a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import Options, postings


def append_postings(stream: DataFrame, options: Options, path: str, checkpoint: str) -> StreamingQuery:
    """Writes postings of arriving records to ``path``, sorted by word within each batch; each batch is written once."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, options).repartitionByRange("word").sortWithinPartitions("word", "doc_id", "position").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
