"""Streams of Spark's own stateful operators: windows, sessions, joins of two streams, and how a stream is read and run. State machines
over the rows of a flow are in `ordered`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.sources.storage import new_table


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and read what it wrote. append: a parquet sink, exactly once. complete:
    the last batch's table."""
    spark = stream.sparkSession
    path = new_table(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_counted(stream: DataFrame) -> tuple[DataFrame, int]:
    """run_available in append mode, and how many rows its stateful operators dropped as too late."""
    spark = stream.sparkSession
    path = new_table(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).format("parquet").option("path", path)
    query = writer.start()
    query.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    return spark.read.schema(stream.schema).parquet(path), late


def late_counts(stream: DataFrame, delay: str, window: str, key: str) -> DataFrame:
    """(start, key, n): rows in windows of event time; a window comes out when the watermark has passed it, and rows that come
    later than that are dropped."""
    rows = with_lateness(stream, delay).groupBy(F.window("ts", window), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), key, "n")


def with_lateness(stream: DataFrame, delay: str, column: str = "ts") -> DataFrame:
    """Rows later than `delay` behind the newest are dropped by the stateful operators that follow."""
    return stream.withWatermark(column, delay)


def idle_sessions(stream: DataFrame, gap: str, key: str = "flow_id") -> DataFrame:
    """Sessions of a flow without a pause of `gap`: grouped by the window expression itself."""
    own = F.session_window("ts", gap)
    return stream.groupBy(key, own).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def ttl_stream(enter: DataFrame, exit_: DataFrame, key: str, limit: str) -> DataFrame:
    """(key, enter, exit): exits of a flow up to `limit` after it entered; both streams keep state no longer than that."""
    a = enter.select(F.col(key).alias("__k"), F.col("ts").alias("enter")).withWatermark("enter", limit)
    b = exit_.select(F.col(key).alias("__x"), F.col("ts").alias("exit")).withWatermark("exit", limit)
    near = (F.col("__k") == F.col("__x")) & (F.col("exit") >= F.col("enter")) & (F.col("exit") <= F.col("enter") + F.expr(f"INTERVAL {limit}"))
    return a.join(b, near).select(F.col("__k").alias(key), "enter", "exit")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; a pattern, as the source takes a folder or a pattern, and the table may be one file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
