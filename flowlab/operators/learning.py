"""Clustering, cumulative-feature classification, sweeps and importances on MLlib and SQL."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.symbols import edges_equal, nearest_edge
from flowlab.sources.storage import materialise


def edges_kmeans(df: DataFrame, value: str, k: int, seed: int = 1) -> list[float]:
    """Centres of the values, sorted. Equal values count together, as weights."""
    rows = df.groupBy(value).agg(F.count("*").cast("double").alias("w")).select(array_to_vector(F.array(F.col(value).cast("double"))).alias("features"), "w")
    model = KMeans(k=k, seed=seed, weightCol="w").fit(rows)
    return sorted(float(c[0]) for c in model.clusterCenters())


def cluster_shares(points: DataFrame, centres: list[list[float]], key: str = "label", vector: str = "v") -> DataFrame:
    """(label, centre, share): a label's inverse distances to each centre, as a share of those to all."""
    rows = points
    far = lambda c: F.sqrt(F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    inverse = F.array(*[1 / (far(c) + 1e-9) for c in centres])
    sums = rows.select(key, F.posexplode(inverse).alias("centre", "x")).groupBy(key, "centre").agg(F.sum("x").alias("x"))
    return sums.select(key, "centre", (F.col("x") / F.sum("x").over(Window.partitionBy(key))).alias("share"))


def spread_scores(shares: DataFrame, key: str = "label") -> DataFrame:
    """One row: the mean variance of shares within labels, within centres, and their product."""
    a = shares.groupBy(key).agg(F.var_pop("share").alias("v")).agg(F.avg("v").alias("spva"))
    c = shares.groupBy("centre").agg(F.var_pop("share").alias("v")).agg(F.avg("v").alias("spvc"))
    return a.join(F.broadcast(c)).withColumn("product", F.col("spva") * F.col("spvc"))


def best_clustering(points: DataFrame, ks, key: str = "label", vector: str = "v", seed: int = 1) -> DataFrame:
    """(k, spva, spvc, product) of the k with the largest product: a fit for each k."""
    rows = points.select(key, F.col(vector).cast("array<double>").alias(vector)).persist()
    best = None
    for k in ks:
        centres = KMeans(k=k, seed=seed).fit(rows.select(array_to_vector(vector).alias("features"))).clusterCenters()
        got = spread_scores(cluster_shares(rows, [list(c) for c in centres], key, vector)).withColumn("k", F.lit(k)).first()
        best = got if best is None or got["product"] > best["product"] else best
    rows.unpersist()
    return points.sparkSession.createDataFrame([(best["k"], best["spva"], best["spvc"], best["product"])], "k int, spva double, spvc double, product double")


def fit_minmax(df: DataFrame, cols) -> DataFrame:
    return df.agg(*[x for c in cols for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])


def scale(df: DataFrame, params: DataFrame, cols) -> DataFrame:
    """Columns to [-1, 1] by the fitted bounds; a constant column becomes 0."""
    out = df.join(F.broadcast(params))
    for c in cols:
        lo, hi = F.col(f"min_{c}"), F.col(f"max_{c}")
        out = out.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo) * 2 - 1).otherwise(0.0))
    return out.drop(*params.columns)


def feature_bounds(rows: DataFrame, features: str = "features") -> tuple[list[float], list[float]]:
    """(least, greatest) of each place of array features. A task sends one row of each, so nothing is exploded for a row."""

    def own(batches):
        lo = hi = None
        for batch in batches:
            x = np.stack(batch[features].to_numpy()) if len(batch) else np.zeros((0, 0))
            if len(x):
                lo = x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))
                hi = x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0))
        if lo is not None:
            yield pd.DataFrame({"lo": [lo], "hi": [hi]})

    parts = rows.select(features).mapInPandas(own, "lo array<double>, hi array<double>")
    places = parts.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "x")).groupBy("i").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    found = sorted(places.collect(), key=lambda r: r.i)
    return [r.lo for r in found], [r.hi for r in found]


def fourier_features(features, lo, hi, n_out: int, gamma: float, seed: int):
    """Random Fourier features of an RBF kernel exp(-gamma |x - y|^2) of features scaled to [-1, 1] by the bounds (0 where they are equal):
    sqrt(2 / n_out) cos(w x + b), w and b from a seeded generator, so that products of rows are the kernel but for some 1 / sqrt(n_out)."""
    low, high = np.asarray(lo, float), np.asarray(hi, float)

    @F.pandas_udf("array<double>")
    def turned(column: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, math.sqrt(2 * gamma), (n_out, len(low))), rng.uniform(0, 2 * math.pi, n_out)
        if not len(column):
            return pd.Series([], dtype=object)
        span = np.where(high > low, high - low, 1)
        x = np.where(high > low, (np.stack(column.to_numpy()) - low) / span * 2 - 1, 0.0)
        return pd.Series(list(math.sqrt(2 / n_out) * np.cos(x @ w.T + b)))

    return turned(features)


#: Bytes of turned rows that the fits of several labels may hold in memory at once.
HELD = 1 << 30


def cumul_classify(train: DataFrame, test: DataFrame, n_in: int, gamma: float = 0.1, c: float = 1.0, n_out: int = 512, seed: int = 1, iterations: int = 1000, tolerance: float = 1e-3) -> DataFrame:
    """(flow_id, day, actual, predicted) of an RBF max-margin classifier on rows (flow_id, day, label, features of n_in places): random
    Fourier features (an approximation of the kernel) and one linear machine per label against the rest. A machine is fitted until its
    loss falls by less than a share of `tolerance`; `iterations` only keeps a fit that doesn't settle from going on for ever. train is
    read twice for each label and turned again, as the turned rows are far larger: it should be a table. Labels are fitted side by
    side as far as their turned rows fit HELD bytes."""
    from pyspark.ml.classification import LinearSVC

    lo, hi = feature_bounds(train)
    if lo and len(lo) != n_in:
        raise ValueError(f"features have {len(lo)} places, not {n_in}")
    x = array_to_vector(fourier_features("features", lo, hi, n_out, gamma, seed)).alias("features")
    rows = train.select("label", x)
    labels = sorted(r.label for r in train.select("label").distinct().collect())

    def fit(label):
        model = LinearSVC(regParam=1 / max(c * 100, 1e-9), maxIter=iterations, tol=tolerance).fit(rows.select("features", (F.col("label") == label).cast("double").alias("label")))
        return model.coefficients.toArray(), float(model.intercept)

    side_by_side = max(1, min(len(labels), HELD // (8 * n_out * max(train.count(), 1))))
    with ThreadPool(side_by_side) as pool:
        machines = pool.map(inheritable_thread_target(train.sparkSession)(fit), labels)
    w, b, names = np.array([m[0] for m in machines]), np.array([m[1] for m in machines]), np.array(labels, object)

    @F.pandas_udf("string")
    def best(column: pd.Series) -> pd.Series:
        return pd.Series(names[(np.stack(column.to_numpy()) @ w.T + b).argmax(axis=1)] if len(column) else [], dtype=object)

    turned = fourier_features("features", lo, hi, n_out, gamma, seed)
    return test.select("flow_id", "day", F.col("label").alias("actual"), best(turned).alias("predicted"))


def hyperparameter_importance(trials: DataFrame, cols, target: str, trees: int = 20, seed: int = 1) -> DataFrame:
    """(name, importance) of a forest regression of the target on the settings."""
    strings = [c for c, t in trials.dtypes if c in cols and t == "string"]
    rows = trials.dropna(subset=[*cols, target])
    for c in strings:
        rows = StringIndexer(inputCol=c, outputCol=f"{c}_i").fit(rows).transform(rows)
    used = [f"{c}_i" if c in strings else c for c in cols]
    model = RandomForestRegressor(featuresCol="f", labelCol=target, numTrees=trees, seed=seed).fit(VectorAssembler(inputCols=used, outputCol="f").transform(rows))
    return trials.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(cols, model.featureImportances.toArray())], "name string, importance double")


def best_bin_count(frames: DataFrame, counts, largest: int = 1500) -> DataFrame:
    """(bins, separation, best): for each number of edges the distance between labels as against within, all counts in one job.

    Sequences of bins are coded as one character per bin; a count is part of the label."""
    from flowlab.operators.similarity import label_pairs

    coded = F.array(*[F.struct(F.lit(n).alias("bins"), F.char(48 + nearest_edge(F.col("tcp_length"), edges_equal(largest, n))).alias("s")) for n in counts])
    rows = frames.select("flow_id", "label", "frame_number", F.inline(coded))
    words = rows.groupBy("flow_id", "label", "bins").agg(F.array_sort(F.collect_list(F.struct("frame_number", "s"))).alias("own"))
    words = words.select("flow_id", "bins", F.concat_ws("|", "bins", "label").alias("label"), F.array_join(F.transform("own", lambda x: x["s"]), "").alias("word"))
    pairs = label_pairs(words, "bins").withColumn("bins", F.substring_index("label_a", "|", 1))
    inside = F.col("label_a") == F.col("label_b")
    mean = lambda c: F.sum(F.when(c, F.col("dist") * F.col("n"))) / F.sum(F.when(c, F.col("n")))
    scores = pairs.groupBy(F.col("bins").cast("int").alias("bins")).agg((mean(~inside) / mean(inside)).alias("separation"))
    scores = materialise(scores, "separations")  # a row for each count; the pairs are measured once
    top = scores.agg(F.max_by("bins", F.struct("separation", -F.col("bins"))).alias("top"))
    return scores.join(F.broadcast(top)).select("bins", "separation", (F.col("bins") == F.col("top")).alias("best"))


def grid(spark, **axes) -> DataFrame:
    """All settings: the product of short lists, given by name."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'int'}")
        out = one if out is None else out.crossJoin(one)
    return out
