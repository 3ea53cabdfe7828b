"""Incremental cleaned-post cache with Structured Streaming.

Event CSV files landing under ``<landing>/<event>/<event>.csv`` are picked up
by a file stream. Each micro-batch lands its cells once, applies the same
header recipe as the batch reader (a file always arrives whole in one batch),
cleans the text natively and adds a run to the cache. The stream's checkpoint
lies beside the cache, one per landing folder, and run names carry it, so
a restarted stream goes on where it stopped, streams of several landings
do not touch each other's runs, and a retried batch overwrites only its own.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import unescape_path
from ..functions.text import clean_text
from ..sources import files as IO


def landing_stream(spark: SparkSession, landing: str, width: int = IO.WIDTH,
                   max_files_per_trigger: int = 1000, event_pattern: str | None = None) -> DataFrame:
    """Streaming positional rows of new event files, with their ``file``."""
    src = (spark.readStream.schema(IO.csv_schema(width)).options(**IO.CSV_OPTIONS)
           .option("maxFilesPerTrigger", max_files_per_trigger)
           .csv(f"{landing.rstrip('/')}/*/*.csv"))
    rows = src.select(*[F.col(f"c{i}") for i in range(width)], "_raw", F.col("_metadata.file_path").alias("file"))
    if event_pattern:
        return rows
    return rows.where(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1) == F.regexp_extract("file", r"/([^/]+)\.[^./]+$", 1))


def start_cache_stream(spark: SparkSession, landing: str, cache_path: str, checkpoint: str | None = None,
                       available_now: bool = True, width: int = IO.WIDTH,
                       event_pattern: str | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what has landed and stops.
    ``event_pattern`` names events from the path as in ``files.read_posts``. The
    files of a batch with a header wider than ``width`` are parsed again at its width."""
    checkpoint = checkpoint or f"{cache_path.rstrip('/')}/checkpoints/{md5(landing.rstrip('/').encode()).hexdigest()}"
    stream = md5(checkpoint.rstrip("/").encode()).hexdigest()

    def sink(batch: DataFrame, batch_id: int) -> None:
        raw = IO.land(IO.cells_frame(batch, width), "stream-cells")
        if (needed := IO.widest_header(raw)) > width:  # the batch's files again, with room for all columns
            raw = IO.land_cells(spark, raw.select(unescape_path("file").alias("path")).distinct(), needed)
        posts = IO.canonical_posts(IO.apply_headers(raw, event_pattern)).withColumn("clean_text", clean_text("text"))
        events = raw.select(IO.event_of_file(event_pattern).alias("event")).distinct()
        IO.write_cache_run(posts, events, cache_path, f"stream-{stream}-{batch_id}")

    writer = (landing_stream(spark, landing, width, event_pattern=event_pattern).writeStream.foreachBatch(sink)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
