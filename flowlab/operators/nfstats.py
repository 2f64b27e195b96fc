"""Statistics of network functions: costs, drops, capacities, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.quantiles import with_percentiles
from flowlab.operators.windows import diffs


def cost_per_packet(nf: DataFrame) -> DataFrame:
    """cost difference / packet difference of each service's rows with new packets."""
    return diffs(nf, "serviceid", "n", ["cost", "rx"]).where("d_rx > 0").withColumn("cost_per_packet", F.col("d_cost") / F.col("d_rx"))


def drops(nf: DataFrame, limit: int = 1000, skip: int = 3, key: str = "run") -> DataFrame:
    """(run, dropped): whether a drop counter of a service past the first `skip` exceeds the limit."""
    return nf.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("serviceid") >= skip, F.col("drop"))) > limit, F.lit(False)).alias("dropped"))


def capacity(runs: DataFrame, by: str, size: str = "models", largest: int = 10) -> DataFrame:
    """Per group of runs (size, dropped): the largest size before the first that drops; `largest` if none does,
    1 if all do."""
    first = F.min(F.when(F.col("dropped"), F.col(size)))
    rows = runs.withColumn("__first", first.over(Window.partitionBy(by)))
    ok = F.max(F.when(F.col(size) < F.col("__first"), F.col(size)))
    return rows.groupBy(by).agg(F.when(F.max("__first").isNull(), largest).otherwise(F.coalesce(ok, F.lit(1))).cast("int").alias("capacity"))


def latency_summary(ttl: DataFrame, by=()) -> DataFrame:
    found = with_percentiles(ttl, by, {"p": F.col("delta")}, (0.5, 0.95, 0.975, 0.99), [F.avg("delta").alias("mean")])
    return found.select(*by, "mean", *[F.get("p", i).alias(n) for i, n in enumerate(("median", "p95", "p975", "p99"))])
