"""Structured Streaming wrappers over the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.operators.ordered import last_row


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Drains the source into parquet under ``path`` (checkpoint beside the data) and stops."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint")
         .trigger(availableNow=True).start(f"{path}/data"))
    q.awaitTermination()


def run_updates(stream: DataFrame, path: str) -> None:
    """Writes each micro-batch's changed rows to its own folder: a replayed batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/data/part={batch_id}")

    q = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/_checkpoint")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every aggregate row."""
    df = spark.read.parquet(f"{path}/data").drop("part")
    return last_row(df, keys, ["batch_id"]).drop("batch_id")


def stream_snapshots(stream: DataFrame, id_col: str, time_col: str, delay: str = "1 day") -> DataFrame:
    """Append stream without repeated ids (a resent batch within ``delay`` is dropped)."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def stream_settle(stream: DataFrame, path: str, settle: Callable[[DataFrame, int], None]) -> None:
    """Keyed merge per micro-batch through ``settle(batch, batch_id)``, which must be idempotent."""
    q = (stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).foreachBatch(settle).start())
    q.awaitTermination()


def stream_period_trend(stream: DataFrame, time_col: str, target: str, cadence: str = "day", delay: str = "7 days") -> DataFrame:
    """Tumbling day or week rates (weeks start on Monday); months by truncated date."""
    d = stream.withWatermark(time_col, delay)
    if cadence == "month":
        key = F.to_date(F.date_trunc("month", time_col)).alias("period_start")
        return d.groupBy(key).agg(F.count("*").alias("matches"), F.sum(target).alias("forfeits"))
    # epoch day 0 is a Thursday: weeks that start on Monday are shifted by 4 days
    w = F.window(time_col, "1 day") if cadence == "day" else F.window(time_col, "7 days", "7 days", "4 days")
    g = d.groupBy(w).agg(F.count("*").alias("matches"), F.sum(target).alias("forfeits"))
    return g.select(F.to_date("window.start").alias("period_start"), "matches", "forfeits")


def stream_form(stream: DataFrame, time_col: str, team: str, won: str, days: int = 7, delay: str = "7 days") -> DataFrame:
    """Sliding counts per team over ``days``, one window per day."""
    w = F.window(time_col, f"{days} days", "1 day")
    g = stream.withWatermark(time_col, delay).groupBy(w, team).agg(F.count("*").alias("maps"), F.sum(won).alias("wins"))
    return g.select(F.to_date("window.end").alias("day"), team, "maps", "wins")


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet folder (or one file of it) as a stream with the schema of its batch read."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def route_late(stream: DataFrame, path: str, time_col: str, delay: str) -> None:
    """Drains the source; rows behind the watermark go to a table of their own and are counted.

    The watermark of a batch is the greatest time of all earlier batches less ``delay`` (an
    interval such as "2 days"). Every batch overwrites its own folders ``kept``, ``late`` and
    ``accounts`` below ``path``, so a replayed batch changes nothing, and sent = kept + late.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = accounts(spark, path).where(F.col("batch") < batch_id).agg((F.max("high") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()["mark"]
        late = F.lit(False) if earlier is None else F.coalesce(F.col(time_col) < F.lit(earlier), F.lit(False))
        batch.withColumn("is_late", late).write.mode("overwrite").partitionBy("is_late").parquet(f"{path}/rows/batch={batch_id}")
        rows = spark.read.schema(f"{time_col} timestamp, is_late boolean").parquet(f"{path}/rows/batch={batch_id}")
        counts = rows.agg(F.count("*").alias("sent"), F.count_if(~F.col("is_late")).alias("kept"), F.count_if("is_late").alias("late"), F.max(time_col).alias("high"))
        counts.write.mode("overwrite").parquet(f"{path}/accounts/batch={batch_id}")

    q = (stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, sent, kept, late, high) of the batches routed so far."""
    schema = "sent long, kept long, late long, high timestamp, batch int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/accounts")
    except AnalysisException:  # nothing routed yet
        return spark.createDataFrame([], schema)


def routed(spark: SparkSession, path: str, schema, late: bool = False) -> DataFrame:
    """The rows kept, or those that came late, with their batch."""
    rows = spark.read.option("basePath", f"{path}/rows").schema(f"{schema}, is_late boolean, batch int").parquet(f"{path}/rows")
    return rows.where(F.col("is_late") == late).drop("is_late")


def drain(stream: DataFrame, path: str, mode: str, keys: list[str] | None = None) -> list[dict]:
    """Runs what is available and returns each batch's late rows as the state operators counted them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/data/part={batch_id}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    return [{"batch": p["batchId"], "dropped": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])} for p in q.recentProgress]


def settle_stream(stream: DataFrame, path: str, table, settle: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], list[int]]:
    """Merges what each batch settles into a keyed table; returns the handler, which a replay may call again.

    ``settle(batch, table rows)`` returns the changed rows. A batch commits under its number,
    so a batch that is replayed after a failure, before or after its commit, counts once.
    """
    def handle(batch: DataFrame, batch_id: int) -> list[int]:
        return table.merge(settle(batch, table.read()), f"batch-{batch_id}")

    q = (stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True)
         .foreachBatch(lambda batch, batch_id: handle(batch, batch_id) and None).start())
    q.awaitTermination()
    return handle
