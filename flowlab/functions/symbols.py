"""Bin edges, symbols of frames and records, and distances: JVM-side column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = 1e-6


def edges_equal(largest: float, n: int) -> list[float]:
    """n points from 0 to largest at equal distances."""
    return [i * largest / (n - 1) for i in range(n)]


def edges_log(largest: float, n: int) -> list[float]:
    """n points from 1 to largest at equal ratios."""
    return [math.exp(i * math.log(largest) / (n - 1)) for i in range(n)]


def edges_single() -> list[float]:
    """One edge, which takes every size to bin 0."""
    return [0.0]


def edges_frequency(df: DataFrame, value: str, n: int) -> DataFrame:
    """One row, `edges`: n + 1 points of the sorted values at equal steps of rank 0..N, interpolated on
    ranks 0..N-1 (the last one is clamped).

    The values are counted by distinct value first; positions are found on running counts, so no list of all
    values is made."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).count()
    total = F.sum("count").over(Window.partitionBy())
    ranked = counts.select("v", F.sum("count").over(Window.orderBy("v")).alias("upto"), "count", total.alias("total"))
    points = ranked.select("v", "upto", "count", "total", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"))
    at = F.least(F.col("i") * F.col("total") / n, F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    first = F.col("upto") - F.col("count")
    near = points.select("i", "v", (at - low).alias("part"), ((low >= first) & (low < F.col("upto"))).alias("is_low"), ((high >= first) & (high < F.col("upto"))).alias("is_high"))
    edges = near.groupBy("i").agg((F.max(F.when(F.col("is_low"), F.col("v"))) * (1 - F.max("part")) + F.max(F.when(F.col("is_high"), F.col("v"))) * F.max("part")).alias("edge"))
    return edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "edge"))), lambda x: x["edge"]).alias("edges"))


def nearest_edge(value: Column, edges) -> Column:
    """Index of the edge nearest to value, the first one on a tie. edges: a list or an array column.

    For a sorted list, a chain of comparisons with the midpoints; for a column, a fold."""
    if isinstance(edges, (list, tuple)):
        out = F.lit(len(edges) - 1)
        for i in range(len(edges) - 2, -1, -1):
            out = F.when(value <= (edges[i] + edges[i + 1]) / 2, i).otherwise(out)
        return F.when(value.isNotNull(), out)
    start = F.struct(F.lit(-1).alias("i"), F.lit(float("inf")).alias("d"), F.lit(0).alias("at"))

    def step(acc, e):
        d = F.abs(e - value).cast("double")
        return F.struct(F.when(d < acc["d"], acc["at"]).otherwise(acc["i"]).alias("i"), F.least(d, acc["d"]).alias("d"), (acc["at"] + 1).alias("at"))

    return F.when(value.isNotNull(), F.aggregate(edges, start, step, lambda acc: acc["i"]))


def side(direction: Column) -> Column:
    return F.when(direction < 0, "C").otherwise("S")


def _type(content: Column, handshake: Column) -> Column:
    return F.concat(content.cast("string"), F.coalesce(F.concat(F.lit(":"), handshake.cast("string")), F.lit("")))


def _size(length: Column, direction: Column, edges, signed: bool) -> Column:
    own = length * direction if signed else length
    return (own if edges is None else nearest_edge(own, edges)).cast("string")


def record_symbol(direction: Column, length: Column, content: Column, handshake: Column, edges=None, signed: bool = False) -> Column:
    """type[:handshake];bin;C or S. Without edges the size itself takes the place of the bin."""
    return F.concat_ws(";", _type(content, handshake), _size(length, direction, edges, signed), side(direction))


def frame_symbol(direction: Column, length: Column, records: Column, edges=None, signed: bool = False, skip_types: bool = False) -> Column:
    """type[:handshake]|type...;bin;C or S of a frame with an array of records (content_type, handshake_type)."""
    kinds = F.lit("") if skip_types else F.array_join(F.transform(records, lambda r: _type(r["content_type"], r["handshake_type"])), "|")
    return F.concat_ws(";", kinds, _size(length, direction, edges, signed), side(direction))


def pad_and_cut(seq: Column, n: int) -> Column:
    """A sequence of one symbol gets a `0` behind it; then the first n are kept."""
    return F.slice(F.when(F.size(seq) == 1, F.array_append(seq, F.lit("0"))).otherwise(seq), 1, n)


def edit_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of sequences coded as one character per symbol."""
    return F.levenshtein(a, b)


def code_symbol(index: Column) -> Column:
    """A character of its own for each dense id: code points from U+4E00 on."""
    return F.decode(F.unhex(F.lpad(F.hex((index + 19968).cast("long")), 4, "0")), "UTF-16BE")


def symbol_hash(direction: Column, size: Column, types: Column) -> Column:
    """64-bit hash of (direction, size high byte, size low byte, type codes): h = 33 h + v from 5381."""
    values = F.concat(F.array(direction, F.floor(size / 256), size % 256).cast("array<bigint>"), types.cast("array<bigint>"))
    word = F.lit("18446744073709551616").cast("decimal(38,0)")
    return F.aggregate(values, F.lit(5381).cast("decimal(38,0)"), lambda h, v: ((h * F.lit(33).cast("decimal(3,0)") + v.cast("decimal(19,0)")) % word).cast("decimal(38,0)"))


def chain_loglik(probabilities: Column) -> Column:
    """Sum of the logarithms; a null probability counts as MISSING."""
    return F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + F.ln(F.coalesce(p, F.lit(MISSING))))


def normalised(score: Column, threshold: Column, mode: str = "ratio") -> Column:
    """Membership scores: ratio |score| / threshold (member up to 1); slack score / (1.1 threshold) (member
    up to 1); floor 1 where score >= threshold."""
    if mode == "ratio":
        return F.abs(score) / threshold
    if mode == "slack":
        return score / (1.1 * threshold)
    return (score >= threshold).cast("int")
