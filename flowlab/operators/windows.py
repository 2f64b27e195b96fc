"""Running values over flows: cumulative sizes, gaps, offsets, splits by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative(frames: DataFrame, key: str = "flow_id") -> DataFrame:
    """total and signed: running sums of sizes, and of sizes with their direction."""
    run = Window.partitionBy(key).orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumns({"total": F.sum(F.abs("tcp_length")).over(run), "signed": F.sum(F.col("tcp_length") * F.col("direction")).over(run)})


def running(df: DataFrame, keys, bucket, order, sums: dict) -> DataFrame:
    """df with running sums (name -> column) of the rows of a key in the order of `bucket` and then `order`.

    In two steps: within each bucket, which is a task's share, and then the sums of the buckets before it, a short table. So a
    key with a third of all rows is spread over its buckets."""
    rows = df.withColumn("__bucket", bucket)
    own = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    offsets = totals.select(*keys, "__bucket", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    out = rows.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(offsets, [*keys, "__bucket"])
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__bucket", *[f"__{n}" for n in sums])


def _field(name: str):
    return lambda x: x[name]


def resample(df: DataFrame, n: int, value: str | list[str], key: str | list[str] = "flow_id", order: str = "frame_number") -> DataFrame:
    """(key, points): the values of a flow, linearly interpolated at n even places from first to last. Of a list of values each gives a
    column of its name, in one pass."""
    keys, values = [key] if isinstance(key, str) else key, [value] if isinstance(value, str) else value
    own = F.struct(F.col(order).alias("o"), *[F.col(v).cast("double").alias(v) for v in values])
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("own")).select(*keys, *[F.transform("own", _field(v)).alias(v) for v in values])

    def points(v):
        def point(i):
            at = i * (F.size(v) - 1) / float(max(n - 1, 1))
            low = F.floor(at).cast("int")
            part = at - low
            return F.get(v, low) * (1 - part) + F.get(v, F.least(low + 1, F.size(v) - 1)) * part

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point).alias("points" if isinstance(value, str) else v)

    return rows.select(*keys, *[points(v) for v in values])


def drop_retransmissions(segments: DataFrame, key=("flow_id",)) -> DataFrame:
    """The first segment of each direction and sequence number."""
    own = Window.partitionBy(*key, "direction", "tcp_seq").orderBy("frame_number")
    return segments.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def cut_at_gap(segments: DataFrame, key=("flow_id",)) -> DataFrame:
    """Segments before the first whose number isn't what its direction's last one leads to. The gap
    ends the whole flow. Retransmissions must be gone."""
    side = Window.partitionBy(*key, "direction").orderBy("frame_number")
    run = Window.partitionBy(*key).orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    want = F.lag(F.col("tcp_seq") + F.col("tcp_len")).over(side)
    return segments.withColumn("__gap", F.coalesce((F.col("tcp_seq") != want).cast("int"), F.lit(0))).withColumn("__gap", F.max("__gap").over(run)).where("__gap = 0").drop("__gap")


def stream_offsets(segments: DataFrame, key=("flow_id",)) -> DataFrame:
    """lo, hi: the bytes of its direction's stream that a segment holds."""
    run = Window.partitionBy(*key, "direction").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("hi", F.sum("tcp_len").over(run)).withColumn("lo", F.col("hi") - F.col("tcp_len"))


def diffs(df: DataFrame, key: str, order: str, cols) -> DataFrame:
    own = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(own) for c in cols})


def experiment_slice(nf: DataFrame, instance: int = 1) -> DataFrame:
    """Rows strictly between the instance's last row with rx 0 and its first row with the final rx."""
    own = nf.where(F.col("instanceid") == instance)
    final = own.agg(F.max_by("rx", "ts").alias("final"))
    edges = own.join(F.broadcast(final)).agg(F.max(F.when(F.col("rx") == 0, F.col("ts"))).alias("start"), F.min(F.when(F.col("rx") == F.col("final"), F.col("ts"))).alias("end"))
    return nf.join(F.broadcast(edges)).where((F.coalesce(F.col("ts") > F.col("start"), F.lit(True))) & (F.col("ts") < F.col("end"))).drop("start", "end")


def head_elements(df: DataFrame, n: int, key: str = "flow_id", order: str = "frame_number") -> DataFrame:
    own = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= n).drop("__n")


def distinct_adjacent(df: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    own = Window.partitionBy(key).orderBy(order)
    rows = df.withColumns({"__last": F.lag(col).over(own), "__n": F.row_number().over(own)})
    return rows.where((F.col("__n") == 1) | ~F.col(col).eqNullSafe(F.col("__last"))).drop("__last", "__n")


def split(urls: DataFrame, n_test: int = 10, n_val: int = 10, seed: str = "") -> DataFrame:
    """dset by the rank of a tag's distinct urls in an order given by md5: the first n_test test, the next n_val
    validation, the rest training. All rows of one url stay together.

    Only the first n_test + n_val urls of a tag are ranked further than their own task; the rest is told by their absence."""
    order = Window.partitionBy("tag").orderBy(F.md5(F.concat(F.col("url"), F.lit(seed))), "url")
    first = urls.select("tag", "url").distinct().withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n_test + n_val)
    rows = urls.join(first, ["tag", "url"], "left")
    return rows.withColumn("dset", F.when(F.col("__rank") <= n_test, "test").when(F.col("__rank") <= n_test + n_val, "val").otherwise("train")).drop("__rank").select(*urls.columns, "dset")


def one_unknown_per_day(meta: DataFrame, closed) -> DataFrame:
    """Open world: closed labels' rows, and of each other label the first row of a day."""
    own = Window.partitionBy("day", "label").orderBy("id")
    rows = meta.withColumn("__n", F.row_number().over(own))
    return rows.where(F.col("label").isin(*closed) | (F.col("__n") == 1)).drop("__n")


def change_points(jobs: DataFrame) -> DataFrame:
    """The measurement days: each distinct scheduled time, numbered in order."""
    return jobs.select("scheduled_date").distinct()


def day_index(meta: DataFrame, day: str = "scheduled_date") -> DataFrame:
    """day_index of each distinct day. Days are numbered in two steps, within their first seven letters (a month) and by the months
    before; Spark sends their table to the tasks where it is small, and else joins it like any other."""
    days = meta.select(day).where(F.col(day).isNotNull()).distinct()
    ranked = running(days, [], F.substring(F.col(day).cast("string"), 1, 7), [day], {"day_index": F.lit(1)})
    return meta.join(ranked.withColumn("day_index", (F.col("day_index") - 1).cast("int")), day)


def size_sequences(df: DataFrame, n: int, key: str = "flow_id") -> DataFrame:
    """(key, sizes): the first n signed sizes of each flow, adjacent repeats of a record left out before."""
    rows = F.slice(F.array_sort(F.collect_list(F.struct("frame_number", (F.col("tcp_length") * F.col("direction")).alias("s")))), 1, n)
    return df.groupBy(key).agg(F.transform(rows, lambda x: x["s"]).alias("sizes"))
