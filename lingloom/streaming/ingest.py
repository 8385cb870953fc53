"""Incremental segmentation: new files are segmented as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingloom.operators import segment as G


def document_stream(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def ingest_segments(docs: DataFrame, output: str, checkpoint: str, key: str = "doc_id", text: str = "text", config: G.SegmentConfig = G.SegmentConfig()):
    """Segment every arriving document into ``output``, one folder a batch, until the present input is used up.

    A batch that is run again after a failure overwrites its own folder, so each
    document counts once however often it was tried.
    """

    def write(batch: DataFrame, number: int) -> None:
        G.segments(batch, key, text, config).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucket_counts(segs: DataFrame, at: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Arriving segments by event-time window and length bucket, late rows within the watermark included."""
    from lingloom.operators.sample import bucket_of

    return segs.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), bucket_of(F.col("length_approx")).alias("bucket")).agg(F.count("*").alias("n"))
