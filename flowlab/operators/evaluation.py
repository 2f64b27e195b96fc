"""Decisions from scores, confusion counts, metrics, and the choice between trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.quantiles import with_percentiles


def arg_best(scores: DataFrame) -> DataFrame:
    """(flow_id, predicted, score): the best score, on a tie the first label."""
    best = F.struct((-F.col("score")).alias("s"), "model_label")
    return scores.groupBy("flow_id").agg(F.min_by("model_label", best).alias("predicted"), F.max("score").alias("score"))


def vote(neighbours: DataFrame, fraction: float | None = None, unknown: str = "unknown") -> DataFrame:
    """(id, predicted, share) of ranked neighbours (id, label, rank): the most frequent label, ties by best rank
    and then name; below `fraction` of the votes it is `unknown`."""
    counts = neighbours.groupBy("id", "label").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
    order = F.struct((-F.col("n")).alias("n"), "best", "label")
    rows = counts.groupBy("id").agg(F.min_by("label", order).alias("predicted"), (F.max("n") / F.sum("n")).alias("share"))
    return rows if fraction is None else rows.withColumn("predicted", F.when(F.col("share") < fraction, unknown).otherwise(F.col("predicted")))


def thresholds(scores: DataFrame, q: float | None = None) -> DataFrame:
    """Per model (rows: its own label's training scores): the largest |score|; or the percentile 100 - q."""
    if q is None:
        return scores.groupBy("model_label").agg(F.max(F.abs("score")).alias("threshold"))
    found = with_percentiles(scores, ["model_label"], {"p": F.col("score")}, [(100 - q) / 100])
    return found.select("model_label", F.get("p", 0).alias("threshold"))


def confusion(pred: DataFrame) -> DataFrame:
    """(day, actual, predicted, n)."""
    return pred.groupBy("day", "actual", "predicted").agg(F.count("*").alias("n"))


def _one_vs_rest(conf: DataFrame) -> DataFrame:
    """(day, label, total, rows, said, tp): each count is a row of its actual and one of its predicted label, summed once."""
    n, none = F.col("n"), F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("actual").alias("label"), n.alias("rows"), none.alias("said"), F.when(F.col("actual") == F.col("predicted"), n).otherwise(none).alias("tp")),
        F.struct(F.col("predicted").alias("label"), none.alias("rows"), n.alias("said"), none.alias("tp")),
    )
    sums = conf.select("day", F.inline(both)).groupBy("day", "label").agg(*[F.sum(c).alias(c) for c in ("rows", "said", "tp")])
    return sums.withColumn("total", F.sum("rows").over(Window.partitionBy("day")))


def _metrics(r: DataFrame) -> DataFrame:
    fp, fn = F.col("said") - F.col("tp"), F.col("rows") - F.col("tp")
    precision = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    return r.select("day", "label", "rows", ((F.col("total") - fp - fn) / F.col("total")).alias("accuracy"), precision.alias("precision"), F.when(F.col("rows") > 0, F.col("tp") / F.col("rows")).alias("recall"))


def metrics_closed(conf: DataFrame) -> DataFrame:
    """Per day and label: one-vs-rest accuracy, precision (0 if never predicted), recall (null without rows)."""
    return _metrics(_one_vs_rest(conf)).drop("rows")


def metrics_open(conf: DataFrame, closed) -> DataFrame:
    """The same with all labels outside the closed set as one class `unknown`."""
    def inside(c):
        return F.when(F.col(c).isin(*closed), F.col(c)).otherwise("unknown")

    return metrics_closed(conf.groupBy("day", inside("actual").alias("actual"), inside("predicted").alias("predicted")).agg(F.sum("n").alias("n")))


def merge_prefixes(conf: DataFrame, prefixes) -> DataFrame:
    """On both axes the first prefix that a label begins with replaces it."""
    def merged(c):
        out = F.col(c)
        for p in reversed(prefixes):
            out = F.when(F.col(c).startswith(p), F.lit(p)).otherwise(out)
        return out

    return conf.groupBy("day", merged("actual").alias("actual"), merged("predicted").alias("predicted")).agg(F.sum("n").alias("n"))


def weighted_scores(conf: DataFrame) -> DataFrame:
    """One row per day: accuracy, and precision, recall and F1 weighted by the labels' rows."""
    m = _metrics(_one_vs_rest(conf)).where("rows > 0")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    weigh = lambda c: F.sum(c * F.col("rows")) / F.sum("rows")
    return m.groupBy("day").agg(weigh(F.col("recall")).alias("accuracy"), weigh(F.col("precision")).alias("precision"), weigh(F.col("recall")).alias("recall"), weigh(f1).alias("f1"))


def macro(metrics: DataFrame, by: str) -> DataFrame:
    """Mean and median of the metrics over the other axis, nulls left out."""
    cols = ("accuracy", "precision", "recall")
    return metrics.groupBy(by).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols], *[F.percentile(c, 0.5).alias(f"median_{c}") for c in cols])


def trial_stats(trials: DataFrame, keys, value: str) -> DataFrame:
    return trials.groupBy(*keys).agg(F.min(value).alias("min"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))


def best_trial(trials: DataFrame, by, steps) -> DataFrame:
    """The trials of a group that pass successive choices: steps are (column, largest wins, tolerance)."""
    rows = trials
    for i, (col, largest, tol) in enumerate(steps):
        own = Window.partitionBy(*by)
        best = F.max(col).over(own) if largest else F.min(col).over(own)
        rows = rows.withColumn("__best", best).where(F.abs(F.col(col) - F.col("__best")) <= tol).drop("__best")
    return rows


def top_configs(trials: DataFrame, tol: float, n: int, purity: str, order) -> DataFrame:
    best = trials.agg(F.max(purity).alias("__best"))
    return trials.join(F.broadcast(best)).where(F.col(purity) >= F.col("__best") - tol).drop("__best").orderBy(*order).limit(n)


def binary_counts(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """tp, fp, tn, fn of each model (scores: model_label, label, score), member if |score| <= threshold."""
    rows = scores.join(F.broadcast(limits), "model_label").withColumns({"own": F.col("label") == F.col("model_label"), "member": F.abs("score") <= F.col("threshold")})
    return rows.groupBy("model_label").agg(F.count_if(F.col("own") & F.col("member")).alias("tp"), F.count_if(~F.col("own") & F.col("member")).alias("fp"), F.count_if(~F.col("own") & ~F.col("member")).alias("tn"), F.count_if(F.col("own") & ~F.col("member")).alias("fn"))


def purity(scores: DataFrame) -> DataFrame:
    """Share of a model's own sequences among its n best, n the number of its own."""
    own = Window.partitionBy("model_label")
    rows = scores.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("score"), "flow_id")), "size": F.count_if(F.col("label") == F.col("model_label")).over(own)})
    return rows.where(F.col("rank") <= F.col("size")).groupBy("model_label").agg((F.count_if(F.col("label") == F.col("model_label")) / F.max("size")).alias("purity"))


def fit_summary(scores: DataFrame) -> DataFrame:
    """Per model, of its own label's scores: sums, means and extremes of train and val, and the share of val not
    worse than the worst of train."""
    own = scores.where(F.col("label") == F.col("model_label"))
    worst = own.where("dset = 'train'").groupBy("model_label").agg(F.min("score").alias("worst"))
    def of(d, f, name):
        return f(F.when(F.col("dset") == d, F.col("score"))).alias(f"{d}_{name}")

    aggs = [of(d, f, n) for d in ("train", "val") for f, n in ((F.sum, "sum"), (F.avg, "mean"), (F.min, "min"), (F.max, "max"))]
    good = F.avg(F.when(F.col("dset") == "val", (F.col("score") >= F.col("worst")).cast("int"))).alias("accuracy")
    return own.join(F.broadcast(worst), "model_label").groupBy("model_label").agg(*aggs, good)
