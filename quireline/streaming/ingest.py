"""Documents that keep arriving: segmented, answered from the memory and logged batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quireline.functions import masking
from quireline.operators.assembly import segments_of
from quireline.operators.memory import lookup
from quireline.operators.segment_text import segment_text


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_segments(docs: DataFrame, dnt: Sequence[str] = (), keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """The segments of streamed plain texts; the work stays inside a row, so there is no state."""
    cut = segment_text(docs, dnt=dnt).select(*keys, "host", "segments")
    nulls = {c: F.lit(None).cast("string") for c in ("variant", "tone")}
    return segments_of(cut, *keys, "host").withColumns({"context": F.col("kind"), **nulls, "slots": masking.plain_slots(F.col("originals"))})


def stream_reuse(docs: DataFrame, memory: DataFrame, out: str, checkpoint: str, dnt: Sequence[str] = ()) -> StreamingQuery:
    """Log each batch's segments with the memory's wording under ``out``.

    Every batch writes its own folder whole, so a batch that runs again after a failure replaces
    what it had written, and each segment is logged once.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = lookup(batch, memory).select("doc_id", "lang", "id", "hash", "kind", F.col("hit").alias("target"), F.col("hit_origin").alias("origin"))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream_segments(docs, dnt).writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_wording(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A running count of wording by segment hash and hour of arrival (``ts``), closed once ``delay`` has passed."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "hash").agg(F.count(F.lit(1)).alias("n"))
