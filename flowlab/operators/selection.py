"""Filters, slices and samples over packets, frames, records and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.text import chance, seeded

#: Labels of infrastructure, never classified.
INFRASTRUCTURE = ("browser", "captcha", "cdn", "dns", "unknown")


def client_hellos(packets: DataFrame, dst_ip: str | None = None) -> DataFrame:
    """Packets with handshake type 1, or whose info names a Client Hello; to one address if given."""
    hit = F.coalesce(F.col("handshake_type") == 1, F.lit(False)) | F.coalesce(F.contains("info", F.lit("Client Hello")), F.lit(False))
    return packets.where(hit if dst_ip is None else hit & (F.col("ip_dst") == dst_ip))


def drop_labels(df: DataFrame, block_list=INFRASTRUCTURE, column: str = "tag") -> DataFrame:
    return df.where(~F.col(column).isin(*block_list) & (F.col(column) != ""))


def label_like(df: DataFrame, pattern: str, column: str = "tag") -> DataFrame:
    return df.where(F.col(column).like(pattern))


def with_direction(packets: DataFrame, client: str | None = None, prefix: str | None = None, key: str = "trace_id") -> DataFrame:
    """direction: -1 from the client, else +1. The client is a column, or else the source of the first packet of
    a trace whose address begins with the prefix."""
    if client is not None:
        return packets.withColumn("direction", F.when(F.col("ip_src") == F.col(client), -1).otherwise(1))
    own = Window.partitionBy(key)
    first = F.min_by("ip_src", F.when(F.col("ip_src").startswith(prefix), F.col("frame_number"))).over(own)
    return packets.withColumn("direction", F.when(F.col("ip_src") == first, -1).otherwise(1))


def within_horizon(frames: DataFrame, until: float, key: str = "flow_id") -> DataFrame:
    """Frames up to the first one that is later than `until` seconds after the flow's first frame."""
    own = Window.partitionBy(key)
    run = own.orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    start = F.min_by("time_epoch", "frame_number").over(own)
    return frames.withColumn("__latest", F.max("time_epoch").over(run) - start).where(F.col("__latest") <= until).drop("__latest")


def select_elements(df: DataFrame, skip_handshake: bool = False, drop_direction: int | None = None) -> DataFrame:
    """Records, or frames by their first record, without handshake records or one direction."""
    keep = F.lit(True)
    if skip_handshake:
        keep = keep & F.col("handshake_type").isNull()
    if drop_direction is not None:
        keep = keep & (F.col("direction") != drop_direction)
    return df.where(keep)


def select_records(records: Column, skip_handshake: bool = False, drop_direction: int | None = None) -> Column:
    """The same on an array of records."""
    def keep(r):
        good = r["handshake_type"].isNull() if skip_handshake else F.lit(True)
        return good if drop_direction is None else good & (r["direction"] != drop_direction)

    return F.filter(records, keep)


def head_frames(flows: DataFrame, n: int = 35, min_frames: int = 6) -> DataFrame:
    """Flows (array `frames`) of at least min_frames frames, cut to the first n."""
    return flows.where(F.size("frames") >= min_frames).withColumn("frames", F.slice("frames", 1, n))


def plausible(flows: DataFrame, max_len: int = 1600, min_frames: int = 4) -> DataFrame:
    """Flows without a frame over max_len bytes, of at least min_frames frames."""
    return flows.where(F.forall("frames", lambda f: f["tcp_length"] <= max_len) & (F.size("frames") >= min_frames))


def random_drop(seqs: DataFrame, p: float, seed: int, key: str = "flow_id") -> DataFrame:
    """With probability one half a sequence loses each place with probability p, by a seeded hash."""
    hit = F.filter(F.transform("seq", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: chance(seed, key, x["i"]) >= p)
    return seqs.withColumn("seq", F.when(chance(seed, key) < 0.5, F.transform(hit, lambda x: x["s"])).otherwise(F.col("seq")))


def exclude_prefix(df: DataFrame, label: str, prefix: str, column: str = "filename") -> DataFrame:
    return df.where(~((F.col("label") == label) & F.col(column).startswith(prefix)))


def failure_summary(failed: DataFrame) -> DataFrame:
    return failed.groupBy("reason").agg(F.count("*").alias("n"))


def first_per(df: DataFrame, key, order) -> DataFrame:
    """The first row of each key. order: columns or expressions."""
    own = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(own)).where("__rank = 1").drop("__rank")


def top_k(df: DataFrame, key, by, k: int) -> DataFrame:
    """The k first rows of each key, ranked; plans a group limit before the shuffle."""
    own = Window.partitionBy(*key).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def sample_per_label(df: DataFrame, n: int, seed: int, key: str = "flow_id") -> DataFrame:
    """At most n rows of each label, in an order given by a seeded hash."""
    return top_k(df, ["label"], [seeded(seed, key), F.col(key)], n).drop("rank")


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(seeded(seed, key), key).limit(n)


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def order_frames(df: DataFrame, key: str = "flow_id") -> DataFrame:
    """Frames sorted by number within their flow."""
    return df.repartition(key).sortWithinPartitions(key, "frame_number")


def train_plus_val(df: DataFrame) -> DataFrame:
    return df.where(F.col("dset") == "train").unionByName(df.where(F.col("dset") == "val"))


def all_labels(closed: DataFrame, open_: DataFrame) -> DataFrame:
    return closed.select("label").union(open_.select("label")).distinct()


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def union_sets(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Union of set-valued maps, as rows (key, value) without repeats."""
    return a.select(key, value).union(b.select(key, value)).distinct()
