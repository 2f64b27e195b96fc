"""Exact percentiles beside other aggregates, for keys of any number of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.sources.storage import materialise

#: Values of a key up to which its distinct values may be held in one aggregate buffer; with more the key is hot.
HOT = 1_000_000
#: Parts into which a pass cuts the range that a percentile lies in: each is one row of counts.
BINS = 4096
#: Rows of a short table that is sent to all tasks.
MAX_BROADCAST = 125_000


def _equal(keys: list[str], mark: str):
    """Keys that are equal, null to null, to those of another table, whose names are marked."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{mark}{i}")) for i, k in enumerate(keys)], F.lit(True))


def _marked(keys: list[str], mark: str) -> list:
    return [F.col(k).alias(f"{mark}{i}") for i, k in enumerate(keys)]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def _part(v, lo, hi):
    """The part of the range lo < hi that v is in, rising with v; lo and hi are never in one. A range over zero is cut by the sign, one over
    more than a factor of 4 by logarithms, and others evenly, so a few passes are enough for any values, however far apart."""
    log = lambda x: F.log(F.abs(x))
    even = (v - lo) / (hi - lo)
    far = (log(v) - log(lo)) / (log(hi) - log(lo))
    share = F.when(F.greatest(F.abs(lo), F.abs(hi)) > 4 * F.least(F.abs(lo), F.abs(hi)), far).otherwise(even)
    inner = F.least(F.floor(share * BINS), F.lit(BINS - 1))
    return F.when(F.signum(lo) != F.signum(hi), F.signum(v).cast("long")).when(v == hi, F.lit(BINS)).otherwise(inner)


def selected(rows: DataFrame, hot: DataFrame, number: int, qs) -> DataFrame:
    """(h, p array) of rows (h, v) and hot (h, n): exact percentiles by distributed selection.

    For each rank that a percentile needs there is a range of values that holds it. A pass counts the values of the ranges in BINS
    parts each, which tasks do for their own rows first; the part with the rank, from its smallest to its largest value, is the next
    range. It ends when all ranges are single values: no more than a row for each part is held of a key. Values are finite."""
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(qs)])).alias("place")
    asked = hot.select("h", place).select("h", "place.*").withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    ranks = asked.select("h", F.explode(F.array("low", "high")).alias("rank")).distinct()
    ends = rows.groupBy("h").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    targets = materialise(ranks.join(ends, "h").withColumn("below", F.lit(0).cast("long")), "ranks")
    while not targets.where("lo < hi").isEmpty():
        ranges = _small(targets.where("lo < hi").select("h", "lo", "hi").distinct(), 2 * number * len(qs))
        inside = rows.join(ranges, "h").where("v BETWEEN lo AND hi")
        counts = inside.groupBy("h", "lo", "hi", _part(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy("h", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        own = (F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("c"))
        moved = targets.where("lo < hi").join(counts, ["h", "lo", "hi"]).where(own).select("h", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"))
        targets = materialise(targets.where("lo = hi").unionByName(moved), "ranks")
    found = asked.join(targets.select("h", F.col("rank").alias("low"), F.col("lo").alias("a")), ["h", "low"]).join(targets.select("h", F.col("rank").alias("high"), F.col("lo").alias("b")), ["h", "high"])
    p = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.col("high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("low")) * F.col("b"))
    return found.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("i", p.alias("p")))).alias("p")).select("h", F.transform("p", lambda x: x["p"]).alias("p"))


def with_percentiles(df: DataFrame, keys, values: dict, qs, others=(), hot: int | None = None) -> DataFrame:
    """(keys, names of values..., others): of each key the percentiles qs (0 to 1, interpolated) of some columns, each an array, beside other
    aggregates. Null values are passed over; a key without values has null.

    A key with over `hot` (HOT) values of a column has that column's percentiles by selection; the others by Spark's own aggregate."""
    keys, others, hot = list(keys), list(others), HOT if hot is None else hot
    named = {f"__{i}": v.cast("double") for i, v in enumerate(values.values())}
    rows = df.select(*keys, *[v.alias(n) for n, v in named.items()])
    names = dict(zip(named, values))
    sizes = rows.groupBy(*keys).agg(*[F.count(n).alias(n) for n in named])
    sizes = materialise(sizes.where(reduce(lambda a, b: a | b, [F.col(n) > hot for n in named])).withColumn("h", F.monotonically_increasing_id()), "hot")
    number = sizes.count()
    if not number:
        full = [F.percentile(v, F.array(*[F.lit(q) for q in qs])).alias(names[n]) for n, v in named.items()]
        return df.groupBy(*keys).agg(*full, *others)
    if not keys:  # all rows are one key's
        return with_percentiles(df.withColumn("__all", F.lit(0)), ["__all"], values, qs, others, hot).drop("__all")
    rows = rows.join(_small(sizes.select(*_marked(keys, "__k"), "h", *[F.col(n).alias(f"n{n}") for n in named]), number), _equal(keys, "__k"), "left")
    out = df.groupBy(*keys).agg(*others, F.count("*").alias("__rows"))
    for n, name in names.items():
        # a column of a key that is hot in another column alone goes the usual way
        many = F.coalesce(F.col(f"n{n}") > hot, F.lit(False))
        usual = rows.where(~many).groupBy(*keys).agg(F.percentile(n, F.array(*[F.lit(q) for q in qs])).alias(name))
        own = sizes.where(F.col(n) > hot)
        chosen = selected(rows.where(many & F.col(n).isNotNull()).select("h", F.col(n).alias("v")), own.select("h", F.col(n).alias("n")), number, qs)
        both = usual.unionByName(own.select(*keys, "h").join(chosen, "h").select(*keys, F.col("p").alias(name)))
        out = out.join(both.select(*_marked(keys, "__j"), name), _equal(keys, "__j"), "left").drop(*[f"__j{i}" for i in range(len(keys))])
    return out.drop("__rows")
