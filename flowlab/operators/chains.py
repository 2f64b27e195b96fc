"""First- and second-order chains over symbol sequences: fit, score, classify."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.symbols import MISSING
from flowlab.operators.evaluation import arg_best

START, END = "START", "END"


def bigrams(seqs: DataFrame, *keep: str, start: bool = True, end: bool = False) -> DataFrame:
    """(keep..., tail, head): neighbours within each sequence, made in the row."""
    path = F.concat(*([F.array(F.lit(START))] if start else []), F.col("seq"), *([F.array(F.lit(END))] if end else []))
    pairs = F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("tail"), F.slice(path, 2, F.size(path)).alias("head"))
    return seqs.where(F.size(path) > 1).select(*keep, F.inline(pairs))


def fit_chain(seqs: DataFrame, end: bool = False, weight: str | None = None) -> DataFrame:
    """Edges (label, tail, head, count, prob) per label: prob = count / sum * (1 - missing * MISSING), where missing is
    the number of the chain's nodes, START among them, that the tail doesn't lead to. weight: a column with how often a sequence counts."""
    each = F.sum(weight) if weight else F.count("*")
    counts = bigrams(seqs, "label", *([weight] if weight else []), end=end).groupBy("label", "tail", "head").agg(each.alias("count"))
    nodes = counts.select("label", "tail").union(counts.select("label", "head")).distinct().groupBy("label").agg(F.count("*").alias("nodes"))
    own = Window.partitionBy("label", "tail")
    rows = counts.withColumns({"sum": F.sum("count").over(own), "out": F.count("*").over(own)}).join(F.broadcast(nodes), "label")
    return rows.select("label", "tail", "head", "count", (F.col("count") / F.col("sum") * (1 - (F.col("nodes") - F.col("out")) * MISSING)).alias("prob"))


def score_chain(seqs: DataFrame, edges: DataFrame, default: float = MISSING, end: bool = False, within: str | None = None) -> DataFrame:
    """(flow_id, model_label, score): log-likelihood of each sequence under each label's chain.

    Each sequence's distinct bigrams are counted first; they meet all labels (a short list) and look up their
    edge; the absent ones count with `default`. With `within`, a column of seqs, they meet only the labels that begin with its value and `|`."""
    models = edges.select(F.col("label").alias("model_label")).distinct()
    keys = ["flow_id"] + ([within] if within else [])
    grams = bigrams(seqs, *keys, end=end).groupBy(*keys, "tail", "head").agg(F.count("*").alias("n"))
    asked = grams.join(F.broadcast(models.withColumn(within, F.substring_index("model_label", "|", 1))), within) if within else grams.crossJoin(F.broadcast(models))
    looked = asked.join(edges.select(F.col("label").alias("model_label"), "tail", "head", "prob"), ["model_label", "tail", "head"], "left")
    return looked.groupBy("flow_id", "model_label").agg(F.sum(F.col("n") * F.ln(F.coalesce("prob", F.lit(default)))).alias("score"))


def chain_classify(train: DataFrame, test: DataFrame) -> DataFrame:
    """(flow_id, predicted, score): chains with START and END per label of train, the best score wins."""
    return arg_best(score_chain(test, fit_chain(train, end=True), end=True))


def trigrams(seqs: DataFrame, *keep: str) -> DataFrame:
    s = F.col("seq")
    zipped = F.arrays_zip(F.slice(s, 1, F.size(s) - 2).alias("prev"), F.slice(s, 2, F.size(s) - 2).alias("curr"), F.slice(s, 3, F.size(s)).alias("next"))
    return seqs.where(F.size(s) > 2).select(*keep, F.inline(zipped))


def _pairs(seqs: DataFrame, first: bool, *keep: str) -> DataFrame:
    at = (1, 2) if first else (-2, -1)
    return seqs.where(F.size("seq") > 1).select(*keep, F.element_at("seq", at[0]).alias("prev"), F.element_at("seq", at[1]).alias("curr"))


def fit_chain2(seqs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(enter, trans, exit): shares of the first pairs, of the third symbol after a pair, and of the last pairs.
    Sequences of one symbol are left out."""
    def shares(rows, keys, group):
        own = Window.partitionBy(*group)
        return rows.groupBy(*keys).agg(F.count("*").alias("count")).withColumn("prob", F.col("count") / F.sum("count").over(own))

    pair = ["label", "prev", "curr"]
    enter = shares(_pairs(seqs, True, "label"), pair, ["label"])
    exit_ = shares(_pairs(seqs, False, "label"), pair, ["label"])
    trans = shares(trigrams(seqs, "label"), [*pair, "next"], pair)
    return enter, trans, exit_


def score_chain2(seqs: DataFrame, enter: DataFrame, trans: DataFrame, exit_: DataFrame, end_default: float = 1e-64, default: float = 1e-32) -> DataFrame:
    """(flow_id, model_label, score) of second-order chains; absent entries count with the defaults."""
    models = enter.select(F.col("label").alias("model_label")).distinct()

    def look(rows, table, keys, absent):
        counted = rows.groupBy("flow_id", *keys).agg(F.count("*").alias("n")).crossJoin(F.broadcast(models))
        own = table.select(F.col("label").alias("model_label"), *keys, "prob")
        return counted.join(own, ["model_label", *keys], "left").select("flow_id", "model_label", (F.col("n") * F.ln(F.coalesce("prob", F.lit(absent)))).alias("part"))

    pair = ["prev", "curr"]
    parts = look(_pairs(seqs, True, "flow_id"), enter, pair, end_default).unionByName(look(trigrams(seqs, "flow_id"), trans, [*pair, "next"], default)).unionByName(look(_pairs(seqs, False, "flow_id"), exit_, pair, end_default))
    return parts.groupBy("flow_id", "model_label").agg(F.sum("part").alias("score"))


def chain2_classify(train: DataFrame, test: DataFrame) -> DataFrame:
    return arg_best(score_chain2(test, *fit_chain2(train)))


def days_curve(seqs: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(cutoff, day, n, correct): chains fitted on the training rows of the days before each cutoff, for all
    cutoffs in one job, and tested on the later days. A cutoff is part of the chain's label."""
    spark = seqs.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(c,) for c in cutoffs], "cutoff int"))
    split = F.concat_ws("|", F.col("cutoff").cast("string"), "label")
    train = seqs.where("dset = 'train'").join(cuts, F.col("day") < F.col("cutoff")).withColumn("label", split)
    test = seqs.where("dset = 'test'").join(cuts, F.col("day") >= F.col("cutoff"))
    scores = score_chain(test.select(F.struct("flow_id", "cutoff").alias("flow_id"), "seq"), fit_chain(train, end=True), end=True)
    own = scores.where(F.substring_index("model_label", "|", 1).cast("int") == F.col("flow_id.cutoff")).withColumn("model_label", F.substring_index("model_label", "|", -1))
    best = arg_best(own).select("flow_id.*", "predicted")
    rows = test.select("flow_id", "cutoff", "day", "label").join(best, ["flow_id", "cutoff"])
    return rows.groupBy("cutoff", "day").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("correct"))


def ensemble(scores: DataFrame, limits: DataFrame, scenario: str = "open") -> DataFrame:
    """One-vs-rest: |score| / threshold of each label's model. open: the best of those up to 1, else `unknown`;
    closed: the best of all."""
    rows = scores.join(F.broadcast(limits), "model_label").withColumn("ratio", F.abs("score") / F.col("threshold"))
    member = F.col("ratio") <= 1 if scenario == "open" else F.lit(True)
    return rows.groupBy("flow_id").agg(F.coalesce(F.min_by("model_label", F.when(member, F.struct("ratio", "model_label"))), F.lit("unknown")).alias("predicted"), F.min(F.when(member, F.col("ratio"))).alias("ratio"))
