"""Joins of the catalogue, of packets with names, and of times and address ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.text import flow_key, hostname, seeded
from flowlab.operators.selection import client_hellos, first_per


def traces_with_urls(traces: DataFrame, urls: DataFrame) -> DataFrame:
    return traces.join(urls.select(F.col("id").alias("url"), F.col("url").alias("address"), "company"), "url")


def traces_with_tags(traces: DataFrame, urls: DataFrame, assign: DataFrame, tags: DataFrame, as_list: bool = False) -> DataFrame:
    """(filename, tag), the first tag in order of name, or (filename, tags)."""
    rows = traces.join(urls.select(F.col("id").alias("url")), "url").join(assign.select(F.col("trace_fk").alias("url"), F.col("tag_fk")), "url").join(tags.select(F.col("id").alias("tag_fk"), "tag"), "tag_fk")
    return rows.groupBy("filename").agg(F.array_sort(F.collect_list("tag")).alias("tags") if as_list else F.min("tag").alias("tag"))


def traces_by_day(traces: DataFrame, days: DataFrame, hours: int = 5) -> DataFrame:
    """Traces begun in [day, day + hours): an equi-join on the hour, then the exact condition."""
    end = F.col("day") + F.make_interval(hours=F.lit(hours))
    spread = days.select("day", F.explode(F.sequence(F.date_trunc("hour", "day"), end, F.expr("INTERVAL 1 HOUR"))).alias("__hour"))
    rows = traces.withColumn("__hour", F.date_trunc("hour", "start_capture")).join(spread, "__hour").drop("__hour")
    return rows.where((F.col("start_capture") >= F.col("day")) & (F.col("start_capture") < end))


def with_split_and_label(meta: DataFrame, indicator: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows with both a set and a label, and the count of the others."""
    kept = meta.join(indicator, "url").join(labels, "url")
    skipped = meta.join(indicator, "url", "left_anti").unionByName(meta.join(indicator, "url", "left_semi").join(labels, "url", "left_anti"))
    return kept, skipped.agg(F.count("*").alias("skipped"))


def align_keys(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return a.join(b.select(key), key, "left_semi"), b.join(a.select(key), key, "left_semi")


def first_address(dns: DataFrame, host_key) -> DataFrame:
    """The first address of the first answer that names the host: dns (trace_id, frame_number, resp_name, dns_a)."""
    return dns.groupBy(*host_key).agg(F.min_by(F.element_at(F.split("dns_a", ","), 1), F.when(F.col("dns_a").isNotNull(), F.col("frame_number"))).alias("address"))


def main_flow_packets(packets: DataFrame, address: DataFrame) -> DataFrame:
    """Packets, either way, of the flow that a trace's first ClientHello to its address (trace_id, address) opens."""
    hello = client_hellos(packets).join(address, "trace_id").where(F.col("ip_dst") == F.col("address"))
    key = flow_key(F.col("ip_src"), F.col("tcp_srcport"), F.col("ip_dst"), F.col("tcp_dstport"))
    main = first_per(hello, ["trace_id"], ["frame_number"]).select("trace_id", key.alias("key"))
    return packets.withColumn("key", key).join(main, ["trace_id", "key"]).drop("key")


def co_flow_packets(packets: DataFrame, seed: int) -> DataFrame:
    """Packets of one other flow of the trace: a ClientHello's but the first's, taken by a seeded hash."""
    key = flow_key(F.col("ip_src"), F.col("tcp_srcport"), F.col("ip_dst"), F.col("tcp_dstport"))
    hello = client_hellos(packets).withColumn("key", key)
    first = hello.groupBy("trace_id").agg(F.min_by("key", "frame_number").alias("main"))
    other = hello.join(first, "trace_id").where(F.col("key") != F.col("main")).groupBy("trace_id").agg(F.min_by("key", seeded(seed, "key.low.ip", "key.low.port", "key.high.ip", "key.high.port")).alias("key"))
    return packets.withColumn("key", key).join(other, ["trace_id", "key"]).drop("key")


def time_to_label(enter: DataFrame, exit_: DataFrame, key, max_delta: float = 1.0) -> DataFrame:
    """Per key: the first enter time, and the earliest exit at most max_delta later; else no row."""
    first = enter.groupBy(*key).agg(F.min("t").alias("enter"))
    rows = exit_.withColumnRenamed("t", "exit").join(first, list(key)).where((F.col("exit") >= F.col("enter")) & (F.col("exit") <= F.col("enter") + max_delta))
    return rows.groupBy(*key, "enter").agg(F.min("exit").alias("exit")).withColumn("delta", F.col("exit") - F.col("enter"))


def destinations_by_domain(packets: DataFrame, dns: DataFrame) -> DataFrame:
    """First packet of each 5-tuple with the domain of its destination: per address the first name asked for."""
    first = first_per(packets, ["trace_id", "protocol", "ip_src", "tcp_srcport", "ip_dst", "tcp_dstport"], ["frame_number"])
    names = dns.groupBy("ip").agg(F.min_by("domain", "frame_number").alias("domain"))
    return first.join(names, first["ip_dst"] == names["ip"])


def with_truth(pred: DataFrame, traces: DataFrame, labels: DataFrame) -> DataFrame:
    return pred.join(traces.select("filename", "url"), "filename").join(labels.select("url", F.col("tag").alias("actual")), "url")


def ip_long(ip):
    p = F.split(ip, r"\.")
    return sum((F.get(p, i).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))


def ip_to_asn(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(ip, asn) by the longest matching prefix (prefix, len, asn); no match: null.

    One equi-join per prefix length that occurs: an address looks up its own prefixes, longest
    first, in (length, network); no range join."""
    lengths = prefixes.select("len").distinct()
    nets = prefixes.select("len", F.floor(ip_long(F.col("prefix")) / F.pow(F.lit(2), 32 - F.col("len"))).cast("long").alias("net"), "asn")
    asked = ips.select("ip").distinct().join(F.broadcast(lengths)).select("ip", "len", F.floor(ip_long(F.col("ip")) / F.pow(F.lit(2), 32 - F.col("len"))).cast("long").alias("net"))
    best = asked.join(nets, ["len", "net"]).groupBy("ip").agg(F.max_by("asn", F.struct("len", "asn")).alias("asn"))
    return ips.join(best, "ip", "left")


def pending(configs: DataFrame, done: DataFrame, ignore=("seed",)) -> DataFrame:
    """Configurations without a finished run; null fields are equal to null."""
    cols = [c for c in configs.columns if c in done.columns and c not in ignore]
    d = done.select(*[F.col(c).alias(f"d_{c}") for c in cols])
    cond = None
    for c in cols:
        one = configs[c].eqNullSafe(d[f"d_{c}"])
        cond = one if cond is None else cond & one
    return configs.join(d, cond, "left_anti")


def records_in_frames(segments: DataFrame, spans: DataFrame, key=("flow_id", "direction"), bucket: int = 16384) -> DataFrame:
    """A record (lo, hi) is in every segment (lo, hi) whose bytes it touches. Both are spread over
    buckets of the stream, joined on them, and counted in the bucket where the overlap begins."""
    def spread(df, prefix):
        lo, hi = F.col(f"{prefix}lo"), F.col(f"{prefix}hi")
        return df.withColumn("__b", F.explode(F.sequence(F.floor(lo / bucket), F.floor((hi - 1) / bucket))))

    s = spread(segments.withColumnsRenamed({"lo": "s_lo", "hi": "s_hi"}).where("s_hi > s_lo"), "s_")
    r = spread(spans.withColumnsRenamed({"lo": "r_lo", "hi": "r_hi"}).where("r_hi > r_lo"), "r_")
    rows = s.join(r, [*key, "__b"]).where((F.col("s_lo") < F.col("r_hi")) & (F.col("r_lo") < F.col("s_hi")))
    return rows.where(F.floor(F.greatest("s_lo", "r_lo") / bucket) == F.col("__b")).drop("__b")


def hosts_of(urls: DataFrame) -> DataFrame:
    return urls.withColumn("host", hostname(F.col("url")))


def assign_tags(urls: DataFrame, tags: DataFrame, host_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new tags, assignments): tags (id, tag) that host_tags (host, tag) names and that don't exist yet get ids
    after the largest; each url is assigned its host's tags."""
    missing = host_tags.select("tag").distinct().join(tags, "tag", "left_anti")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    new = missing.withColumn("n", F.row_number().over(Window.orderBy("tag"))).join(F.broadcast(top)).select((F.col("top") + F.col("n")).cast("long").alias("id"), "tag")
    every = tags.select(F.col("id").cast("long"), "tag").unionByName(new)
    return new, hosts_of(urls).select(F.col("id").alias("url"), "host").join(host_tags, "host").join(every.withColumnRenamed("id", "tag_fk"), "tag").select("tag_fk", F.col("url").alias("trace_fk"))


def export_file_index(traces: DataFrame, urls: DataFrame, browsers: DataFrame) -> DataFrame:
    """company x browser x set -> files; empty lists where there is none. The three lists are short."""
    sets = browsers.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "dset string")
    grid = urls.select("company").distinct().crossJoin(browsers).crossJoin(sets)
    rows = traces.join(urls.select(F.col("id").alias("url"), "company"), "url")
    files = rows.groupBy("company", "browser", "dset").agg(F.array_sort(F.collect_list("filename")).alias("files"))
    return grid.join(files, ["company", "browser", "dset"], "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def job_rows(urls: DataFrame, browsers: DataFrame, now) -> DataFrame:
    """A scheduled job for each url and browser; there are a handful of browsers."""
    return urls.select(F.col("id").alias("url")).crossJoin(F.broadcast(browsers)).select("url", "browser", F.lit("scheduled").alias("state"), now.alias("scheduled_date"))
