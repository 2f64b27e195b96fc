"""Percentiles of hot keys by selection, against Spark's own."""

import pytest
from pyspark.sql import functions as F

from flowlab.operators import aggregates as A
from flowlab.operators import quantiles as Q
from flowlab.plans import views as V

QS = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)


def own(df, keys, values):
    return df.groupBy(*keys).agg(*[F.percentile(v.cast("double"), F.array(*map(F.lit, QS))).alias(n) for n, v in values.items()], F.count("*").alias("n"))


def same(got, want):
    flat = lambda df: sorted(([None if v is None else [round(x, 9) for x in v] if isinstance(v, list) else v for v in (r[c] for c in sorted(df.columns))] for r in df.collect()), key=str)
    assert flat(got) == flat(want) and got.count()


@pytest.fixture(scope="module")
def table(spark):
    """Keys with many rows, few, none that counts, equal values, values far apart and close together, and the null key."""
    n = spark.range(0, 6000, 1, 7)
    kind = F.pmod(F.xxhash64("id"), F.lit(7))
    v = (
        F.when(kind == 0, F.lit(4.5)).when(kind == 1, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)).cast("double")).when(kind == 2, F.exp(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(700)).cast("double")))
        .when(kind == 3, 1 + F.col("id") * 1e-15).when(kind == 4, -F.col("id") / 7.0).when((kind == 5) & (F.col("id") < 50), F.col("id") / 3.0)
    )
    return n.select(F.when(kind != 4, F.concat(F.lit("k"), kind.cast("string"))).alias("key"), "id", v.alias("v"), F.when(F.col("id") % 2 == 0, -v).alias("w")).persist()


@pytest.mark.parametrize("hot", [0, 500])
def test_hot_keys_by_selection(table, hot):
    values = {"p": F.col("v"), "q": F.col("w")}
    same(Q.with_percentiles(table, ["key"], values, QS, [F.count("*").alias("n")], hot), own(table, ["key"], values))


def test_passes_over_small_parts(table, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 200)
    same(Q.with_percentiles(table, ["key"], {"p": F.col("v")}, QS, [F.count("*").alias("n")], 20), own(table, ["key"], {"p": F.col("v")}))


def test_without_a_key_and_with_two(table):
    for keys in ([], ["key", "half"]):
        rows = table.withColumn("half", F.col("id") % 2)
        same(Q.with_percentiles(rows, keys, {"p": F.col("v")}, QS, [F.count("*").alias("n")], 30), own(rows, keys, {"p": F.col("v")}))


def test_summary_is_the_same_for_hot_keys(spark, small, monkeypatch):
    frames = V.frames(spark, small)
    want = A.summary8(frames, "label", "tcp_length", log2=True).collect()
    monkeypatch.setattr(Q, "HOT", 20)
    got = A.summary8(frames, "label", "tcp_length", log2=True).collect()
    rows = {r.label: r[1:] for r in got}
    assert rows.keys() == {r.label for r in want} and all(rows[r.label] == pytest.approx(r[1:]) for r in want)


def test_no_rows(table):
    assert Q.with_percentiles(table.limit(0), ["key"], {"p": F.col("v")}, QS).count() == 0
