"""Per-flow statistics, conversations, histograms and entropies."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.text import flow_key, record_type_name
from flowlab.operators.quantiles import with_percentiles
from flowlab.operators.windows import running
from flowlab.sources.storage import materialise


def frame_counts(frames: DataFrame, key: str = "flow_id") -> DataFrame:
    return frames.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("direction") > 0).alias("incoming"), F.count_if(F.col("direction") < 0).alias("outgoing"))


def record_counts(frames: DataFrame, key: str = "flow_id", records: str = "n_records") -> DataFrame:
    """Sums of records per frame; `records` is their number, or size(tls_records)."""
    n = F.col(records)
    return frames.groupBy(key).agg(F.sum(n).alias("total"), F.coalesce(F.sum(F.when(F.col("direction") > 0, n)), F.lit(0)).alias("incoming"), F.coalesce(F.sum(F.when(F.col("direction") < 0, n)), F.lit(0)).alias("outgoing"))


def handshake_counts(frames: DataFrame, key: str = "flow_id") -> DataFrame:
    """Frames (content_type: of their first record) that begin with a handshake record, by direction."""
    shake = F.col("content_type") == 22
    return frames.groupBy(key).agg(F.count_if(shake).alias("total"), F.count_if(shake & (F.col("direction") > 0)).alias("incoming"), F.count_if(shake & (F.col("direction") < 0)).alias("outgoing"))


def summary8(df: DataFrame, key: str, value: str, log2: bool = False) -> DataFrame:
    """min, p01, p05, median, mean, p95, p99, max of each key; log2: also of the logarithms (zeros are left out
    there). Exact percentiles, by linear interpolation. A key without values has the summary of one 0."""
    v = F.col(value).cast("double")
    columns = {"": v} | ({"log_": F.when(v > 0, F.log2(v))} if log2 else {})
    plain = [f(c).alias(f"__{prefix}{n}") for prefix, c in columns.items() for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    found = with_percentiles(df, [key], {f"__{prefix}p": c for prefix, c in columns.items()}, (0.01, 0.05, 0.5, 0.95, 0.99), plain)
    out = []
    for prefix in columns:
        own = {n: F.col(f"__{prefix}{n}") for n in ("min", "mean", "max")} | {n: F.get(f"__{prefix}p", i) for i, n in enumerate(("p01", "p05", "median", "p95", "p99"))}
        out += [F.coalesce(own[n].cast("double"), F.lit(None if prefix else 0.0)).alias(prefix + n) for n in ("min", "p01", "p05", "median", "p95", "p99", "mean", "max")]
    return found.select(key, *out)


def size_lists(frames: DataFrame, key: str = "flow_id") -> DataFrame:
    """Ordered size lists: all, incoming, outgoing."""
    def ordered(when):
        rows = F.array_sort(F.collect_list(F.when(when, F.struct("frame_number", "tcp_length"))))
        return F.transform(rows, lambda x: x["tcp_length"])

    return frames.groupBy(key).agg(ordered(F.lit(True)).alias("total"), ordered(F.col("direction") > 0).alias("incoming"), ordered(F.col("direction") < 0).alias("outgoing"))


def sizes_by_type(records: DataFrame, key: str = "flow_id") -> DataFrame:
    name = record_type_name(F.col("content_type"), F.col("handshake_type"))
    return records.groupBy(key, name.alias("type"), "direction").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, share): the share of values up to each distinct value. Values are counted before they are ordered;
    the running sum is over distinct values, in ranges of about equal numbers of them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranges = counts.agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 1000).alias("__edges"), F.sum("n").alias("__all"))
    rows = counts.join(F.broadcast(ranges))  # one row
    bucket = F.size(F.filter("__edges", lambda e: e < F.col("value")))
    return running(rows, [], bucket, ["value"], {"upto": F.col("n")}).select("value", (F.col("upto") / F.col("__all")).alias("share"))


def conversations(packets: DataFrame) -> DataFrame:
    """Per trace and TCP pair: frames and bytes out, in and together, start, duration. Out: from the pair's first sender."""
    rows = packets.withColumn("key", flow_key(F.col("ip_src"), F.col("tcp_srcport"), F.col("ip_dst"), F.col("tcp_dstport")))
    low = (F.col("ip_src") == F.col("key.low.ip")) & (F.col("tcp_srcport") == F.col("key.low.port"))
    own = rows.groupBy("trace_id", "key").agg(F.min_by(low, "frame_number").alias("first_low"), F.count_if(low).alias("frames_low"), F.sum(F.when(low, F.col("frame_len")).otherwise(0)).alias("bytes_low"), F.count("*").alias("total_frames"), F.sum("frame_len").alias("total_bytes"), F.min("time_epoch").alias("start"), (F.max("time_epoch") - F.min("time_epoch")).alias("duration"))
    out = lambda low_col, all_col: F.when(F.col("first_low"), F.col(low_col)).otherwise(F.col(all_col) - F.col(low_col))
    src, dst = F.when(F.col("first_low"), F.col("key.low")).otherwise(F.col("key.high")), F.when(F.col("first_low"), F.col("key.high")).otherwise(F.col("key.low"))
    named = own.select("trace_id", src.alias("src"), dst.alias("dst"), out("frames_low", "total_frames").alias("frames_out"), out("bytes_low", "total_bytes").alias("bytes_out"), "total_frames", "total_bytes", "start", "duration")
    return named.select("trace_id", F.col("src.ip").alias("src"), F.col("src.port").alias("src_port"), F.col("dst.ip").alias("dst"), F.col("dst.port").alias("dst_port"), "frames_out", "bytes_out", (F.col("total_frames") - F.col("frames_out")).alias("frames_in"), (F.col("total_bytes") - F.col("bytes_out")).alias("bytes_in"), "total_frames", "total_bytes", "start", "duration")


def trace_rollup(conv: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("frames_out", "bytes_out", "frames_in", "bytes_in", "total_frames", "total_bytes")]
    return conv.groupBy("trace_id").agg(*sums, F.min("start").alias("start"), F.avg("duration").alias("duration"))


def observation_space(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.explode("seq").alias("symbol")).distinct()


def label_means(stats: DataFrame, cols) -> DataFrame:
    return stats.groupBy("label").agg(*[x for c in cols for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))])


def histogram(df: DataFrame, key: str, value: str, bins: int, log: bool = False) -> DataFrame:
    """(key, bin, n): counts in equal bins between the smallest and largest value of all (of their logarithms)."""
    v = F.ln(F.col(value).cast("double")) if log else F.col(value).cast("double")
    rows = df.where((F.col(value) > 0) if log else F.col(value).isNotNull()).select(key, v.alias("v"))
    edges = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return rows.join(F.broadcast(edges)).groupBy(key, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def urls_of_hosts(urls: DataFrame, host) -> DataFrame:
    """(host, id): one row for each url, whatever number a host has."""
    return urls.select(host.alias("host"), "id")


def urls_by_host(urls: DataFrame, host, most: int = 100_000) -> DataFrame:
    """(host, ids): the urls of each host in one array. Hosts with over `most` urls are an error: urls_of_hosts has them in rows."""
    largest = urls.groupBy(host.alias("host")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a host has {largest} urls, more than {most}: use urls_of_hosts")
    return urls.groupBy(host.alias("host")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def throughput(timings: DataFrame, key: str, value: str) -> DataFrame:
    return timings.groupBy(key).agg((1 / F.avg(value)).alias("per_second"))


def size_overhead(before: DataFrame, after: DataFrame, key: str = "flow_id", value: str = "length") -> DataFrame:
    """Mean over flows of the bytes after, as a share of those before."""
    a, b = (d.groupBy(key).agg(F.sum(value).alias(n)) for d, n in ((before, "before"), (after, "after")))
    return a.join(b, key).agg(F.avg(F.col("after") / F.col("before")).alias("overhead"))


#: Distinct values of a key that one task of a bootstrap holds, and draws that it keeps at once.
VALUES, DRAWS = 4096, 1 << 22


def _seed(seed: int, *names) -> list[int]:
    """A generator's seed from names: the same in every run and on every machine."""
    return list(hashlib.sha256(repr((seed, *names)).encode()).digest()[:16])


def bootstrap_weights(df: DataFrame, key: str, value: str, b: int, seed: int, salt: str = "") -> DataFrame:
    """(key, sample, v, w): b resamples of each key, as the number of times w that its distinct values v are drawn; each resample has
    exactly as many draws as the key has values (nulls apart).

    A splitting tree: equal values are counted first, and the values of a key are cut into leaves of about VALUES. From the counts of
    the leaves, a short table, the draws of each resample are split over the leaves, and then within a leaf over its values, both as a multinomial
    distribution whose generator is seeded by the resample's and the leaf's name. So a leaf needs nothing but its own values and its share, a lost task
    draws the same again, and the result does not depend on how rows are partitioned."""
    kind = dict(df.dtypes)[key]
    own = df.select(F.col(key).alias("__key"), F.col(value).cast("double").alias("v")).where("v is not null").groupBy("__key", "v").agg(F.count("*").alias("n"))
    own = materialise(own, "values")
    leaves = own.groupBy(F.col("__key").alias("__own")).agg((1 + F.count("*") / VALUES).cast("int").alias("leaves"))
    own = own.join(leaves, F.col("__key").eqNullSafe(F.col("__own"))).select("__key", "v", "n", F.pmod(F.xxhash64("v"), F.col("leaves")).cast("int").alias("leaf"))
    counts = own.groupBy("__key", "leaf").agg(F.sum("n").alias("n"))

    def shares(frame: pd.DataFrame) -> pd.DataFrame:
        """(leaf, shares): how many draws of each resample a leaf gets."""
        frame = frame.sort_values("leaf", ignore_index=True)
        name, n = frame["__key"].iat[0], frame["n"].to_numpy()
        rng = np.random.default_rng(_seed(seed, salt, "split", str(name)))
        drawn = rng.multinomial(int(n.sum()), n / n.sum(), size=b)
        return pd.DataFrame({"__key": frame["__key"], "leaf": frame["leaf"], "shares": list(drawn.T)})

    split = counts.groupBy("__key").applyInPandas(shares, f"__key {kind}, leaf int, shares array<long>").withColumnsRenamed({"__key": "__own", "leaf": "__leaf"})

    def draw(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                v, n, share = np.asarray(r.vs, float), np.asarray(r.ns, float), np.asarray(r.shares, np.int64)
                rng = np.random.default_rng(_seed(seed, salt, "leaf", str(r.name), r.leaf))
                step = max(1, DRAWS // len(v))
                for at in range(0, b, step):
                    w = rng.multinomial(share[at : at + step], n / n.sum())
                    sample, place = np.nonzero(w)
                    yield pd.DataFrame({"name": pd.Series([r.name] * len(sample), dtype=object), "sample": at + sample + 1, "v": v[place], "w": w[sample, place]})

    held = own.groupBy("__key", "leaf").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("rows"))  # about VALUES of them
    rows = held.join(split, F.col("__key").eqNullSafe(F.col("__own")) & (F.col("leaf") == F.col("__leaf")))
    out = rows.select(F.col("__key").alias("name"), "leaf", F.col("rows.v").alias("vs"), F.col("rows.n").alias("ns"), "shares").mapInPandas(draw, f"name {kind}, sample int, v double, w long")
    return out.withColumnRenamed("name", key)


def weighted_mean(v, w):
    return F.sum(v * w) / F.sum(w)


def bootstrap_samples(df: DataFrame, key: str, value: str, b: int, seed: int, statistic=weighted_mean, salt: str = "") -> DataFrame:
    """(key, sample, m): a statistic of b resamples of each key. `statistic` makes an aggregate of a column of values and one
    of weights, the numbers of times that a value is drawn."""
    return bootstrap_weights(df, key, value, b, seed, salt).groupBy(key, "sample").agg(statistic(F.col("v"), F.col("w")).alias("m"))


def _observed(df: DataFrame, key: str, value: str, statistic) -> DataFrame:
    rows = df.select(key, F.col(value).cast("double").alias("v"), F.lit(1).alias("w")).where("v is not null")
    return rows.groupBy(key).agg(statistic(F.col("v"), F.col("w")).alias("mean"))


def bootstrap_ci(df: DataFrame, key: str, value: str, level: float = 0.95, b: int = 1000, seed: int = 1, statistic=weighted_mean) -> DataFrame:
    """The statistic (`mean`) with an interval from reflected percentiles of the resampled ones."""
    half = (1 - level) / 2
    spread = bootstrap_samples(df, key, value, b, seed, statistic).groupBy(key).agg(F.percentile("m", half).alias("lo"), F.percentile("m", 1 - half).alias("hi"))
    return _observed(df, key, value, statistic).join(spread, key).select(key, "mean", (2 * F.col("mean") - F.col("hi")).alias("low"), (2 * F.col("mean") - F.col("lo")).alias("high"))


def _p_value(moved: DataFrame, by, side: str):
    """moved: the resampled statistic r under the null hypothesis, and the observed one, s."""
    below, above = (F.avg(c.cast("int")) for c in (F.col("r") <= F.col("s"), F.col("r") >= F.col("s")))
    p = {"both": F.least(F.lit(1.0), 2 * F.least(below, above)), "less": below, "greater": above}[side]
    return moved.groupBy(*by).agg(p.alias("p"))


def bootstrap_test(df: DataFrame, key: str, value: str, null: float, b: int = 1000, seed: int = 1, statistic=weighted_mean, side: str = "both") -> DataFrame:
    """p-value of statistic = null: resamples recentred at null. side: `both` (twice the smaller tail), `less` or `greater`, the
    alternative that it is smaller or greater than null."""
    moved = bootstrap_samples(df, key, value, b, seed, statistic).join(_observed(df, key, value, statistic), key)
    return _p_value(moved.select(key, (F.col("m") - F.col("mean") + null).alias("r"), F.col("mean").alias("s")), [key], side)


def bootstrap_two_samples(first: DataFrame, second: DataFrame, key: str, value: str, b: int = 1000, seed: int = 1, statistic=weighted_mean, side: str = "both") -> DataFrame:
    """(key, difference, p): of each key in both tables the difference of the statistic, first less second, and the p-value of it being 0. The
    two are resampled apart, and the resampled differences are recentred at 0. side as in bootstrap_test."""
    both = []
    for salt, df in (("first", first), ("second", second)):
        rows = bootstrap_samples(df, key, value, b, seed, statistic, salt).join(_observed(df, key, value, statistic), key)
        both.append(rows.select(key, "sample", F.col("m").alias(f"m_{salt}"), F.col("mean").alias(f"s_{salt}")))
    moved = both[0].join(both[1], [key, "sample"]).withColumn("s", F.col("s_first") - F.col("s_second"))
    moved = moved.select(key, "s", (F.col("m_first") - F.col("m_second") - F.col("s")).alias("r"))
    return _p_value(moved, [key, "s"], side).select(key, F.col("s").alias("difference"), "p")
