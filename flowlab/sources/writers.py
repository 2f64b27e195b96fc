"""Sinks: data sets, features, models and predictions as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str) -> None:
    """One folder per set and label, with all days."""
    df.write.partitionBy("dset", "label").parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    df.withColumn("features", F.col("features").cast("array<float>")).write.parquet(path)


def write_model(df: DataFrame, path: str) -> None:
    df.write.partitionBy("label").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str, batch: int = 0) -> None:
    """The predictions of a batch; maps of scores are kept as maps and as JSON. A batch is a folder of its own, which a repeated run
    replaces, so its rows are there once. read_predictions gives a row per trace over all batches."""
    maps = [c for c, t in df.dtypes if t.startswith("map<")]
    df.withColumns({f"{c}_json": F.to_json(c) for c in maps}).write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def stream_predictions(stream: DataFrame, path: str, checkpoint: str):
    """A started query that writes each micro-batch under its number: one that is run again after a failure replaces what it had written."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, number: write_predictions(df, path, number)).start()


def read_predictions(spark: SparkSession, path: str, key: str = "flow_id") -> DataFrame:
    """One row per trace: that of the last batch which has it; within a batch equal traces are one row, the smallest."""
    rows = spark.read.parquet(path)
    plain = [c for c, t in rows.dtypes if not t.startswith("map<")]
    order = Window.partitionBy(key).orderBy(F.desc("batch"), *[F.col(c).asc_nulls_last() for c in plain if c not in (key, "batch")])
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "batch")
