"""Masking of documents as they arrive.

Every stage works within one document, so a micro-batch goes through the same plan
as a table; the sink is written per batch under the batch's number, so that a batch
that is tried again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kasumi import values as V
from kasumi.operators.spans import regex_hits
from kasumi.plans.masking import Masking, chunked


def contacts(stream: DataFrame, *, text: str = "text") -> DataFrame:
    """The stream's rows with their contact spans; without state, so it may run continuously."""
    return stream.withColumn("contacts", F.when(F.contains(text, F.lit("@")), regex_hits(F.col(text), V.EMAIL)))


def contact_counts(stream: DataFrame, *, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes", text: str = "text") -> DataFrame:
    """(window, documents, contacts) of event-time windows; rows later than ``late`` are left out."""
    own = contacts(stream.withWatermark(time, late), text=text)
    return own.groupBy(F.window(time, window)).agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.size("contacts"), F.lit(0))).alias("contacts"))


def masked(stream: DataFrame, masking: Masking, path: str, checkpoint: str, *, key: str = "doc_id", text: str = "text", **trigger) -> StreamingQuery:
    """Writes (doc_id, masked_text) and the mapping of each micro-batch under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        _, result = masking.mask_documents(chunked(batch, key=key, text=text))
        result.texts.write.mode("overwrite").parquet(f"{path}/texts/batch={number}")
        result.mapping.write.mode("overwrite").parquet(f"{path}/mapping/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
