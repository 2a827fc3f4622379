"""The embedding cache kept by a stream of entity texts: each micro-batch is one incremental sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillgraph.session import shared_dir


def missing_vectors(batch: DataFrame, cached: DataFrame | None) -> DataFrame:
    """The batch's latest text of each key that the cache lacks or holds for another text."""
    rows = batch.dropDuplicates(["key", "text"])
    return rows if cached is None else rows.join(cached.select("key", "text"), ["key", "text"], "left_anti")


def stream_sync(texts: DataFrame, cache: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str | None = None, **options) -> StreamingQuery:
    """Starts a query over texts (key, text) that embeds new ones and adds them to the Parquet cache.

    A batch is written under its own number and replaced when it is repeated, so a restart adds nothing twice.
    """
    spark = texts.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        try:
            cached = spark.read.parquet(cache).where(f"batch < {number}")
        except Exception as none_yet:
            if "PATH_NOT_FOUND" not in str(none_yet) and "UNABLE_TO_INFER_SCHEMA" not in str(none_yet):
                raise
            cached = None
        embed(missing_vectors(batch, cached)).write.mode("overwrite").parquet(f"{cache}/batch={number}")

    writer = texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/embedding-sync")
    for k, v in options.items():
        writer = writer.trigger(**{k: v})
    return writer.start()
