"""Weekly counts over a stream of events: an extension, as the batch engine has no streams.

The counts have a watermark, so late events are dropped after it and state stays bounded. A batch of
closed weeks is written by partition, so a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources.readers import write_panel


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def weekly_counts(events: DataFrame, entity: str, ts: str = "ts", late: str = "14 days") -> DataFrame:
    """(entity, week, cases); weeks start on Monday."""
    week = F.window(ts, "7 days", startTime="4 days").alias("w")
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(entity, week).agg(F.count(F.lit(1)).alias("cases")).select(entity, F.to_date("w.start").alias("week"), "cases")


def start(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of closed weeks into the partitions of their weeks."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write_panel(df, path, ["week"])).trigger(availableNow=True).start()
