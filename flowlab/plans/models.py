"""Queries of sequence models, similarities, evaluation and learning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.functions.symbols import edges_equal, nearest_edge
from flowlab.operators import chains as C
from flowlab.operators import evaluation as E
from flowlab.operators import hmm as H
from flowlab.operators import learning as L
from flowlab.operators import reassembly as R
from flowlab.operators import similarity as S
from flowlab.operators import windows as W
from flowlab.operators.aggregates import size_overhead
from flowlab.plans import views as V
from flowlab.plans.base import query
from flowlab.plans.flows import rounded
from flowlab.sources.storage import materialise

SQ = f"WITH {V.SEQS}"


def bigrams_sql(name: str, where: str, key: str, end: bool) -> str:
    last = f" UNION ALL SELECT {key}, arg_max(symbol, frame_number), 'END' FROM symbols WHERE {where} GROUP BY flow_id, {key}" if end else ""
    return f", {name} AS (SELECT {key}, coalesce(lag(symbol) OVER (PARTITION BY flow_id ORDER BY frame_number), 'START') AS tail, symbol AS head FROM symbols WHERE {where}{last})"


def chain_sql(train: str, test: str, end: bool, keep: str = "") -> str:
    """Edges of the training rows, and scores of the test rows under each label's chain."""
    return (
        bigrams_sql("tr", train, "label", end)
        + ", cnt AS (SELECT label, tail, head, count(*) AS count FROM tr GROUP BY ALL), nod AS (SELECT label, count(*) AS nodes FROM (SELECT label, tail FROM cnt UNION SELECT label, head FROM cnt) GROUP BY label)"
        + ", edges AS (SELECT label, tail, head, count, count / sum(count) OVER (PARTITION BY label, tail) * (1 - (nodes - count(*) OVER (PARTITION BY label, tail)) * 1e-6) AS prob FROM cnt JOIN nod USING (label))"
        + bigrams_sql("te", test, "flow_id", end)
        + ", scores AS (SELECT flow_id, m.label AS model_label, sum(ln(coalesce(prob, 1e-6))) AS score FROM te CROSS JOIN (SELECT DISTINCT label FROM edges) m LEFT JOIN edges e ON e.label = m.label AND e.tail = te.tail AND e.head = te.head GROUP BY ALL)"
    )


TRAIN, TEST = "dset = 'train'", "dset = 'test'"
CHAIN = f"WITH {V.SYMBOLS}" + chain_sql(TRAIN, TEST, True)
OPEN = f"WITH {V.SYMBOLS}" + chain_sql(TRAIN, "true", False)
BEST = ", best AS (SELECT flow_id, arg_min(model_label, {'s': -round(score, 9), 'l': model_label}) AS predicted, max(score) AS score FROM scores GROUP BY flow_id)"
CONF = BEST + ", meta AS (SELECT DISTINCT flow_id, label, day FROM symbols), conf AS (SELECT day, label AS actual, predicted, count(*) AS n FROM best JOIN meta USING (flow_id) GROUP BY ALL)"


def _chain(spark, d):
    s = V.seqs(spark, d)
    return s, C.score_chain(s.where(TEST), C.fit_chain(s.where(TRAIN), end=True), end=True).withColumn("score", F.round("score", 9))


def _conf(spark, d):
    s, scores = _chain(spark, d)
    pred = E.arg_best(scores).join(s.select("flow_id", F.col("label").alias("actual"), "day"), "flow_id")
    return E.confusion(pred)


@query("a12_fit_chain", CHAIN + " SELECT label, tail, head, count, round(prob, 9) AS prob FROM edges")
def a12(spark, d):
    return C.fit_chain(V.seqs(spark, d).where(TRAIN), end=True).withColumn("prob", F.round("prob", 9))


@query("j11_score_chain", CHAIN + " SELECT flow_id, model_label, round(score, 6) AS score FROM scores")
def j11(spark, d):
    return _chain(spark, d)[1].withColumn("score", F.round("score", 6))


@query("f14_chain_loglik", "WITH p AS (SELECT user_id, value / 1000 AS p FROM events) SELECT user_id, round(sum(ln(CASE WHEN p > 0.0001 THEN p ELSE 1e-6 END)), 6) AS loglik FROM p GROUP BY user_id")
def f14(spark, d):
    from flowlab.functions.symbols import chain_loglik

    p = F.when(F.col("value") / 1000 > 0.0001, F.col("value") / 1000)
    rows = V.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", p.alias("p")))).alias("x"))
    return rows.select("user_id", F.round(chain_loglik(F.transform("x", lambda r: r["p"])), 6).alias("loglik"))


@query("m2_chain_classify", CHAIN + BEST + " SELECT flow_id, predicted, round(score, 6) AS score FROM best")
def m2(spark, d):
    return E.arg_best(_chain(spark, d)[1]).withColumn("score", F.round("score", 6))


@query("a16_confusion", CHAIN + CONF + " SELECT CAST(day AS INT) AS day, actual, predicted, n FROM conf")
def a16(spark, d):
    return _conf(spark, d)


def metrics_sql(conf: str = "conf") -> str:
    return f""", lab AS (SELECT day, actual AS label FROM {conf} UNION SELECT day, predicted FROM {conf}), tot AS (SELECT day, sum(n) AS total FROM {conf} GROUP BY day),
act AS (SELECT day, actual AS label, sum(n) AS n_rows, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM {conf} GROUP BY ALL), sai AS (SELECT day, predicted AS label, sum(n) AS said FROM {conf} GROUP BY ALL),
met AS (SELECT day, label, n_rows, (total - (coalesce(said, 0) - coalesce(tp, 0)) - (coalesce(n_rows, 0) - coalesce(tp, 0))) / total AS accuracy, CASE WHEN said > 0 THEN coalesce(tp, 0) / said ELSE 0 END AS precision, CASE WHEN n_rows > 0 THEN tp / n_rows END AS recall FROM lab JOIN tot USING (day) LEFT JOIN act USING (day, label) LEFT JOIN sai USING (day, label))"""


MET = " SELECT CAST(day AS INT) AS day, label, round(CAST(accuracy AS DOUBLE), 6) AS accuracy, round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall FROM met"


@query("a17_metrics_closed", CHAIN + CONF + metrics_sql() + MET)
def a17(spark, d):
    return rounded(E.metrics_closed(_conf(spark, d)), "day", "label")


CLOSED = ("L0", "L1", "L2")
OPENED = ", oc AS (SELECT day, CASE WHEN actual IN ('L0', 'L1', 'L2') THEN actual ELSE 'unknown' END AS actual, CASE WHEN predicted IN ('L0', 'L1', 'L2') THEN predicted ELSE 'unknown' END AS predicted, sum(n) AS n FROM conf GROUP BY ALL)"


@query("a18_metrics_open", CHAIN + CONF + OPENED + metrics_sql("oc") + MET)
def a18(spark, d):
    return rounded(E.metrics_open(_conf(spark, d), CLOSED), "day", "label")


@query("a19_merge_prefixes", CHAIN + CONF + " SELECT CAST(day AS INT) AS day, CASE WHEN actual LIKE 'L1%' THEN 'L1' WHEN actual LIKE 'L%' THEN 'L' ELSE actual END AS actual, CASE WHEN predicted LIKE 'L1%' THEN 'L1' WHEN predicted LIKE 'L%' THEN 'L' ELSE predicted END AS predicted, CAST(sum(n) AS BIGINT) AS n FROM conf GROUP BY ALL")
def a19(spark, d):
    return E.merge_prefixes(_conf(spark, d), ["L1", "L"])


@query("a20_weighted_scores", CHAIN + CONF + metrics_sql() + " SELECT CAST(day AS INT) AS day, round(CAST(sum(recall * n_rows) / sum(n_rows) AS DOUBLE), 6) AS accuracy, round(CAST(sum(precision * n_rows) / sum(n_rows) AS DOUBLE), 6) AS precision, round(CAST(sum(recall * n_rows) / sum(n_rows) AS DOUBLE), 6) AS recall, round(CAST(sum(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END * n_rows) / sum(n_rows) AS DOUBLE), 6) AS f1 FROM met WHERE n_rows IS NOT NULL GROUP BY day")
def a20(spark, d):
    return rounded(E.weighted_scores(_conf(spark, d)), "day")


@query("a21_macro", CHAIN + CONF + metrics_sql() + " SELECT label, " + ", ".join(f"round(CAST(avg({c}) AS DOUBLE), 6) AS mean_{c}, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS median_{c}" for c in ("accuracy", "precision", "recall")) + " FROM met GROUP BY label")
def a21(spark, d):
    return rounded(E.macro(E.metrics_closed(_conf(spark, d)), "label"), "label")


# thresholds, ensembles, trials


def _open(spark, d):
    """Scores of all sequences under chains of the training rows, without END; written once, as limits and decisions both read them."""
    s = materialise(V.seqs(spark, d), "seqs")
    scores = C.score_chain(s, C.fit_chain(s.where(TRAIN))).withColumn("score", F.round("score", 9))
    return materialise(scores.join(s.select("flow_id", "label", "dset", "day"), "flow_id"), "scores")


SCORED = OPEN + ", meta AS (SELECT DISTINCT flow_id, label, dset, day FROM symbols), sc AS (SELECT s.flow_id, model_label, round(score, 9) AS score, label, dset, day FROM scores s JOIN meta USING (flow_id))"
THR = ", thr AS (SELECT model_label, max(abs(score)) AS threshold FROM sc WHERE label = model_label AND dset = 'train' GROUP BY model_label)"


def _limits(rows):
    return E.thresholds(rows.where("label = model_label and dset = 'train'"))


@query("a14_thresholds", SCORED + THR + " SELECT model_label, round(threshold, 6) AS threshold FROM thr")
def a14(spark, d):
    return rounded(_limits(_open(spark, d)), "model_label")


@query("a14_threshold_percentile", SCORED + " SELECT model_label, round(quantile_cont(score, 0.01), 6) AS threshold FROM sc WHERE label = model_label AND dset = 'val' GROUP BY model_label")
def a14_q(spark, d):
    return rounded(E.thresholds(_open(spark, d).where("label = model_label and dset = 'val'"), 99), "model_label")


@query("a15_vote", "WITH c AS (SELECT user_id AS id, event_type AS label, count(*) AS n, min(event_id) AS best FROM events GROUP BY ALL) SELECT id, CASE WHEN max(n) / sum(n) < 0.3 THEN 'unknown' ELSE arg_min(label, {'n': -n, 'b': best, 'l': label}) END AS predicted, round(max(n) / sum(n), 6) AS share FROM c GROUP BY id")
def a15(spark, d):
    rows = V.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), F.col("event_id").alias("rank"))
    return E.vote(rows, 0.3).withColumn("share", F.round("share", 6))


@query("m9_ensemble_open", SCORED + THR + ", r AS (SELECT flow_id, model_label, abs(score) / threshold AS ratio FROM sc JOIN thr USING (model_label) WHERE dset = 'test') SELECT flow_id, coalesce(arg_min(model_label, {'r': round(ratio, 12), 'l': model_label}) FILTER (ratio <= 1), 'unknown') AS predicted FROM r GROUP BY flow_id")
def m9(spark, d):
    rows = _open(spark, d)
    return C.ensemble(rows.where(TEST), _limits(rows), "open").select("flow_id", "predicted")


@query("m9_ensemble_closed", SCORED + THR + ", r AS (SELECT flow_id, model_label, abs(score) / threshold AS ratio FROM sc JOIN thr USING (model_label) WHERE dset = 'test') SELECT flow_id, arg_min(model_label, {'r': round(ratio, 12), 'l': model_label}) AS predicted FROM r GROUP BY flow_id")
def m9_closed(spark, d):
    rows = _open(spark, d)
    return C.ensemble(rows.where(TEST), _limits(rows), "closed").select("flow_id", "predicted")


@query("a26_binary_counts", SCORED + THR + " SELECT model_label, count(*) FILTER (label = model_label AND abs(score) <= threshold) AS tp, count(*) FILTER (label <> model_label AND abs(score) <= threshold) AS fp, count(*) FILTER (label <> model_label AND abs(score) > threshold) AS tn, count(*) FILTER (label = model_label AND abs(score) > threshold) AS fn FROM sc JOIN thr USING (model_label) WHERE dset = 'test' GROUP BY model_label")
def a26(spark, d):
    rows = _open(spark, d)
    return E.binary_counts(rows.where(TEST), _limits(rows))


@query("a27_purity", SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY model_label ORDER BY score DESC, flow_id) AS rank, count(*) FILTER (label = model_label) OVER (PARTITION BY model_label) AS size FROM sc) SELECT model_label, round(count(*) FILTER (label = model_label) / max(size), 6) AS purity FROM r WHERE rank <= size GROUP BY model_label")
def a27(spark, d):
    return rounded(E.purity(_open(spark, d)), "model_label")


@query("a40_fit_summary", SCORED + ", own AS (SELECT * FROM sc WHERE label = model_label), wo AS (SELECT model_label, min(score) AS worst FROM own WHERE dset = 'train' GROUP BY model_label) SELECT model_label, " + ", ".join(f"round({f}(score) FILTER (dset = '{s}'), 6) AS {s}_{n}" for s in ("train", "val") for f, n in (("sum", "sum"), ("avg", "mean"), ("min", "min"), ("max", "max"))) + ", round(avg(CAST(score >= worst AS INT)) FILTER (dset = 'val'), 6) AS accuracy FROM own JOIN wo USING (model_label) GROUP BY model_label")
def a40(spark, d):
    return rounded(E.fit_summary(_open(spark, d)), "model_label")


TRIALS = "WITH trials AS (SELECT p_partkey AS id, p_brand AS method, p_size AS bins, round(p_retailprice / 2500, 4) AS purity, p_partkey % 30 AS trace, round(sin(p_partkey) * 100, 4) AS nll FROM part)"


def _trials(spark, d):
    p = V.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("method"), F.col("p_size").alias("bins"), F.round(F.col("p_retailprice") / 2500, 4).alias("purity"), (F.col("p_partkey") % 30).alias("trace"), F.round(F.sin("p_partkey") * 100, 4).alias("nll"))


@query("a24_trial_stats", TRIALS + " SELECT method, min(purity) AS min, round(quantile_cont(purity, 0.5), 6) AS median, round(avg(purity), 6) AS mean, max(purity) AS max, count(*) AS n FROM trials GROUP BY method")
def a24(spark, d):
    return rounded(E.trial_stats(_trials(spark, d), ["method"], "purity"), "method", "n")


STEP = "{n} AS (SELECT * FROM {f} QUALIFY abs({c} - {a}({c}) OVER (PARTITION BY method)) <= {t})"


@query("a25_best_trial", TRIALS + ", " + ", ".join(STEP.format(n=f"t{i}", f=f"t{i - 1}" if i else "trials", c=c, a="max" if m else "min", t=t) for i, (c, m, t) in enumerate((("purity", True, 0.05), ("bins", False, 2), ("trace", False, 3), ("nll", False, 0)))) + " SELECT id, method FROM t3")
def a25(spark, d):
    return E.best_trial(_trials(spark, d), ["method"], [("purity", True, 0.05), ("bins", False, 2), ("trace", False, 3), ("nll", False, 0)]).select("id", "method")


@query("t3_top_configs", TRIALS + " SELECT id, purity FROM trials WHERE purity >= (SELECT max(purity) FROM trials) - 0.05 ORDER BY purity DESC, id LIMIT 20")
def t3(spark, d):
    return E.top_configs(_trials(spark, d), 0.05, 20, "purity", [F.desc("purity"), "id"]).select("id", "purity")


# second-order chains

PAIRS = ", fst AS (SELECT flow_id, label, dset, seq[1] AS prev, seq[2] AS curr FROM seqs WHERE len(seq) > 1), lst AS (SELECT flow_id, label, dset, seq[-2] AS prev, seq[-1] AS curr FROM seqs WHERE len(seq) > 1), tri AS (SELECT * FROM (SELECT flow_id, label, dset, lag(symbol, 2) OVER w AS prev, lag(symbol) OVER w AS curr, symbol AS next FROM symbols WINDOW w AS (PARTITION BY flow_id ORDER BY frame_number)) WHERE prev IS NOT NULL)"
FIT2 = "".join(f", {n} AS (SELECT {k}, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY {g}) AS prob FROM {t} WHERE dset = 'train' GROUP BY {k})" for n, t, k, g in (("ent", "fst", "label, prev, curr", "label"), ("ext", "lst", "label, prev, curr", "label"), ("trs", "tri", "label, prev, curr, next", "label, prev, curr")))


@query("a13_fit_chain2", SQ + PAIRS + FIT2 + " SELECT 'enter' AS kind, label, prev, curr, '' AS next, count, round(prob, 9) AS prob FROM ent UNION ALL SELECT 'exit', label, prev, curr, '', count, round(prob, 9) FROM ext UNION ALL SELECT 'trans', label, prev, curr, next, count, round(prob, 9) FROM trs")
def a13(spark, d):
    enter, trans, exit_ = C.fit_chain2(V.seqs(spark, d).where(TRAIN))
    none = lambda df, k: df.withColumns({"kind": F.lit(k), "next": F.lit("")})
    return none(enter, "enter").unionByName(none(exit_, "exit")).unionByName(trans.withColumn("kind", F.lit("trans"))).withColumn("prob", F.round("prob", 9))


LOOK2 = ", m AS (SELECT DISTINCT label FROM ent), parts AS (" + " UNION ALL ".join(f"SELECT x.flow_id, m.label AS model_label, ln(coalesce(prob, {z})) AS part FROM {t} x CROSS JOIN m LEFT JOIN {n} p ON p.label = m.label AND p.prev = x.prev AND p.curr = x.curr{e} WHERE x.dset = 'test'" for n, t, z, e in (("ent", "fst", "1e-64", ""), ("ext", "lst", "1e-64", ""), ("trs", "tri", "1e-32", " AND p.next = x.next"))) + "), scores AS (SELECT flow_id, model_label, sum(part) AS score FROM parts GROUP BY ALL)"


def _chain2(spark, d):
    s = V.seqs(spark, d)
    return C.score_chain2(s.where(TEST), *C.fit_chain2(s.where(TRAIN)))


@query("j12_score_chain2", SQ + PAIRS + FIT2 + LOOK2 + " SELECT flow_id, model_label, round(score, 6) AS score FROM scores")
def j12(spark, d):
    return _chain2(spark, d).withColumn("score", F.round("score", 6))


@query("m3_chain2_classify", SQ + PAIRS + FIT2 + LOOK2 + BEST + " SELECT flow_id, predicted FROM best")
def m3(spark, d):
    return E.arg_best(_chain2(spark, d).withColumn("score", F.round("score", 9))).select("flow_id", "predicted")


def _cut_sql(c: int) -> str:
    own = chain_sql(f"dset = 'train' AND day < {c}", f"dset = 'test' AND day >= {c}", True)
    return f"SELECT * FROM (WITH x AS (SELECT 1){own}{BEST}, meta AS (SELECT DISTINCT flow_id, label, day FROM symbols) SELECT {c} AS cutoff, CAST(day AS INT) AS day, count(*) AS n, count(*) FILTER (label = predicted) AS correct FROM best JOIN meta USING (flow_id) GROUP BY day)"


@query("m16_days_curve", f"WITH {V.SYMBOLS} " + " UNION ALL ".join(_cut_sql(c) for c in (2, 5, 8)))
def m16(spark, d):
    return C.days_curve(V.seqs(spark, d), [2, 5, 8])


# similarity

NEAR = ", near AS (SELECT a.flow_id AS id, b.flow_id AS train_id, b.label, levenshtein(a.word, b.word) AS dist, row_number() OVER (PARTITION BY a.flow_id ORDER BY levenshtein(a.word, b.word), b.flow_id) AS rank FROM seqs a JOIN seqs b ON a.dset = 'test' AND b.dset = 'train' QUALIFY rank <= 3)"


@query("j10_nearest", SQ + NEAR + " SELECT id, train_id, label, CAST(dist AS INT) AS dist, CAST(rank AS INT) AS rank FROM near")
def j10(spark, d):
    w = materialise(V.words(spark, d), "flows")
    return S.nearest(w.where(TEST), w.where(TRAIN), 3)


@query("m1_knn", SQ + NEAR + ", c AS (SELECT id, label, count(*) AS n, min(rank) AS best FROM near GROUP BY ALL) SELECT id, CASE WHEN max(n) / sum(n) < 0.5 THEN 'unknown' ELSE arg_min(label, {'n': -n, 'b': best, 'l': label}) END AS predicted, round(max(n) / sum(n), 6) AS share FROM c GROUP BY id")
def m1(spark, d):
    w = materialise(V.words(spark, d), "flows")
    return S.knn(w.where(TRAIN), w.where(TEST), 3, 0.5).withColumn("share", F.round("share", 6))


PAIR = ", pairs AS (SELECT least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b, levenshtein(a.word, b.word) AS dist FROM seqs a JOIN seqs b ON a.flow_id < b.flow_id)"


def _pairs(spark, d):
    """Of the flows of all users."""
    return S.label_pairs(V.words(spark, d))


J9_SQL = SQ + PAIR + " SELECT label_a, label_b, CAST(dist AS INT) AS dist, count(*) AS n FROM pairs GROUP BY ALL"


@query("j9_label_pairs_all", J9_SQL)
@query("j9_label_pairs", J9_SQL)
def j9(spark, d):
    return _pairs(spark, d)


A28_SQL = SQ + PAIR + " SELECT label_a, label_b, CAST(min(dist) AS INT) AS min, round(quantile_cont(dist, 0.05), 6) AS p05, round(quantile_cont(dist, 0.5), 6) AS median, round(quantile_cont(dist, 0.95), 6) AS p95, round(avg(dist), 6) AS mean, CAST(max(dist) AS INT) AS max FROM pairs GROUP BY ALL"


@query("a28_similarity_all", A28_SQL)
@query("a28_similarity", A28_SQL)
def a28(spark, d):
    return rounded(S.similarity_summary(_pairs(spark, d)), "label_a", "label_b", "min", "max")


A29_SQL = SQ + PAIR + ", m AS (SELECT label_a, label_b, 2 * avg(dist) AS d FROM pairs GROUP BY ALL) SELECT label_a, label_b, round(d, 6) AS d FROM m UNION ALL SELECT label_b, label_a, round(d, 6) FROM m WHERE label_a <> label_b"


@query("a29_distance_matrix_all", A29_SQL)
@query("a29_distance_matrix", A29_SQL)
def a29(spark, d):
    return rounded(S.distance_matrix(_pairs(spark, d)), "label_a", "label_b")


A30_SQL = SQ + ", x AS (SELECT a.label, a.word, quantile_cont(levenshtein(a.word, b.word), 0.5) AS d FROM seqs a JOIN seqs b ON a.label = b.label GROUP BY a.label, a.word) SELECT label, arg_min(word, {'d': d, 'w': word}) AS word, min(d) AS median FROM x GROUP BY label"


@query("a30_median_sequence_all", A30_SQL)
@query("a30_median_sequence", A30_SQL)
def a30(spark, d):
    return S.median_sequence(V.words(spark, d))


# hidden Markov models


def _ids(spark, d):
    """Whole sequences as ids of a vocabulary of the training rows."""
    s = V.seqs(spark, d)
    vocab = S.vocabulary(s.where(TRAIN)).persist()
    return S.encode(s, vocab), vocab.count()


def _profiles(spark, d, iterations=8, seeds=(1,)):
    ids, size = _ids(spark, d)
    return ids, H.phmm_fit(ids, 6, size, seeds, iterations)


@query("m4_phmm_fit")
def m4(spark, d):
    return _profiles(spark, d, 2, (1, 2))[1].select("label", "length", "size", "nll")


@query("m5_phmm_score")
def m5(spark, d):
    ids, params = _profiles(spark, d)
    return H.phmm_score(ids.where(TEST), params)


@query("m6_viterbi")
def m6(spark, d):
    ids, params = _profiles(spark, d)
    return H.phmm_viterbi(ids.where(TEST), params)


@query("m7_alignment_prior")
def m7(spark, d):
    w = materialise(V.words(spark, d), "flows")
    return H.alignment_counts(w, S.median_sequence(w))


@query("m8_dense_hmm")
def m8(spark, d):
    ids, size = _ids(spark, d)
    return H.hmm_score(ids.where(TEST), H.hmm_fit(ids.where(TRAIN), 3, size, iterations=8))


# learning


@query("f17_minmax", "WITH x AS (SELECT vec_id, label, embedding[1] AS a, embedding[2] AS b FROM embeddings), p AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM x WHERE vec_id % 2 = 0) SELECT vec_id, round(CAST((a - la) / (ha - la) * 2 - 1 AS DOUBLE), 3) AS a, round(CAST((b - lb) / (hb - lb) * 2 - 1 AS DOUBLE), 3) AS b FROM x, p")
def f17(spark, d):
    x = V.table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))
    return L.scale(x, L.fit_minmax(x.where("vec_id % 2 = 0"), ["a", "b"]), ["a", "b"]).select("vec_id", F.round(F.col("a").cast("double"), 3).alias("a"), F.round(F.col("b").cast("double"), 3).alias("b"))


def _points(spark, d):
    return V.table(spark, d, "embeddings").select("label", F.slice("embedding", 1, 4).cast("array<double>").alias("v"))


CENTRES = [[0.0, 0.0, 0.0, 0.0], [0.5, 0.5, 0.5, 0.5], [-0.5, 0.5, -0.5, 0.5]]
FAR = ", ".join("1 / (sqrt(" + " + ".join(f"(v[{i + 1}] - ({c}))**2" for i, c in enumerate(row)) + ") + 1e-9)" for row in CENTRES)


@query("a36_cluster_shares", f"WITH p AS (SELECT label, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), x AS (SELECT label, unnest([{FAR}]) AS x, unnest([0, 1, 2]) AS centre FROM p), s AS (SELECT label, centre, sum(x) AS x FROM x GROUP BY ALL) SELECT label, centre, round(x / sum(x) OVER (PARTITION BY label), 6) AS share FROM s")
def a36(spark, d):
    return L.cluster_shares(_points(spark, d), CENTRES).withColumn("share", F.round("share", 6))


#: Points to which each of a flow's two running sums is resampled.
POINTS = 100


@query("m10_cumul_classify")
def m10(spark, d):
    keys = ["flow_id", "label", "day", "dset"]
    rows = W.resample(W.cumulative(V.frames(spark, d)), POINTS, ["total", "signed"], keys)
    rows = materialise(rows.select(*keys, F.concat("total", "signed").alias("features")), "features")
    return L.cumul_classify(rows.where(TRAIN), rows.where(TEST), 2 * POINTS)


@query("m12_edges_kmeans")
def m12(spark, d):
    f = V.frames(spark, d).select((F.col("tcp_length") * F.col("direction")).alias("size"))
    return spark.createDataFrame([(i, x) for i, x in enumerate(L.edges_kmeans(f, "size", 6))], "i int, edge double")


@query("m13_best_clustering")
def m13(spark, d):
    return L.best_clustering(_points(spark, d), range(2, 5))


COUNTS = [2, 4, 8]


@query("m14_best_bin_count", f"WITH {V.FRAMES}, c AS (SELECT unnest({COUNTS}) AS bins), w AS (SELECT bins, flow_id, label, string_agg(chr(48 + CAST(least(bins - 1, greatest(0, ceil(tcp_length / (1500 / (bins - 1)) - 0.5))) AS INT)), '' ORDER BY frame_number) AS word FROM frames, c GROUP BY ALL), p AS (SELECT a.bins, a.label = b.label AS inside, levenshtein(a.word, b.word) AS d FROM w a JOIN w b ON a.bins = b.bins AND a.flow_id < b.flow_id), s AS (SELECT bins, avg(d) FILTER (NOT inside) / avg(d) FILTER (inside) AS separation FROM p GROUP BY bins) SELECT bins, round(separation, 6) AS separation, row_number() OVER (ORDER BY separation DESC, bins) = 1 AS best FROM s")
def m14(spark, d):
    return L.best_bin_count(V.frames(spark, d), COUNTS).withColumn("separation", F.round("separation", 6))


GRID = "SELECT method, bins, length, label FROM (VALUES ('equal'), ('log')) a(method), (VALUES (10), (40)) b(bins), (VALUES (5), (10), (15)) c(length), (SELECT DISTINCT 'L' || (user_id % 7) AS label FROM events) e"


@query("m15_grid", GRID)
def m15(spark, d):
    g = L.grid(spark, method=["equal", "log"], bins=[10, 40], length=[5, 10, 15])
    return g.crossJoin(V.frames(spark, d).select("label").distinct())


SWEEP = (
    "WITH " + V.SYMBOLS.replace("symbols AS (", "base AS (") + ", symbols AS (SELECT * EXCLUDE (flow_id, label), flow_id * 100 + length AS flow_id, length || '|' || label AS label FROM base, (VALUES (3), (6), (12)) l(length) WHERE frame_number <= length)" + chain_sql(TRAIN, TEST, True)
    + ", best AS (SELECT flow_id, arg_max(model_label, {'s': score, 'l': model_label}) AS predicted FROM scores WHERE CAST(split_part(model_label, '|', 1) AS INT) = flow_id % 100 GROUP BY flow_id), meta AS (SELECT DISTINCT flow_id, label FROM symbols) SELECT CAST(flow_id % 100 AS INT) AS length, count(*) AS n, count(*) FILTER (label = predicted) AS correct FROM best JOIN meta USING (flow_id) GROUP BY ALL"
)


@query("m15_sweep", SWEEP)
def m15_sweep(spark, d):
    """Chains for several sequence lengths in one job; the length is part of the chain's label."""
    s = V.seqs(spark, d).crossJoin(F.broadcast(spark.createDataFrame([(3,), (6,), (12,)], "length int")))
    s = s.withColumns({"seq": F.slice("seq", F.lit(1), F.col("length")), "label": F.concat_ws("|", F.col("length").cast("string"), "label"), "flow_id": F.struct("flow_id", "length")})
    scores = C.score_chain(s.where(TEST), C.fit_chain(s.where(TRAIN), end=True), end=True)
    own = scores.where(F.substring_index("model_label", "|", 1).cast("int") == F.col("flow_id.length"))
    rows = E.arg_best(own).join(s.select("flow_id", "label"), "flow_id")
    return rows.groupBy(F.col("flow_id.length").alias("length")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("correct"))


@query("m17_importance")
def m17(spark, d):
    return L.hyperparameter_importance(_trials(spark, d), ["method", "bins", "trace"], "purity")


# records on the wire


def _wire(spark, d):
    r = V.records(spark, d)
    return r.withColumn("length", F.greatest(F.floor(F.col("length") / 50), F.lit(1)).cast("int"))


WIRE = f"WITH {V.RECORDS}, w AS (SELECT flow_id, direction, record_number, content_type, CAST(greatest(length // 50, 1) AS INT) AS length FROM records), n AS (SELECT flow_id, direction, content_type, length, row_number() OVER o - 1 AS record_number, CAST(sum(length + 5) OVER o AS BIGINT) AS hi FROM w WINDOW o AS (PARTITION BY flow_id, direction ORDER BY record_number))"


@query("m20_reassemble", WIRE + " SELECT flow_id, direction, CAST(record_number AS INT) AS record_number, content_type, length, hi - length - 5 AS lo, hi FROM n")
def m20(spark, d):
    return R.reassemble(R.segments_of(_wire(spark, d), 200))[0].select("flow_id", "direction", "record_number", "content_type", "length", "lo", "hi")


@query("m20_records_in_frames", WIRE + ", t AS (SELECT flow_id, direction, max(hi) AS total FROM n GROUP BY ALL), s AS (SELECT flow_id, direction, i, i * 200 AS lo, least((i + 1) * 200, total) AS hi FROM t, range(400) AS g(i) WHERE i * 200 < total) SELECT flow_id, direction, CAST(2 * i + CASE WHEN direction > 0 THEN 1 ELSE 0 END AS INT) AS frame_number, CAST(record_number AS INT) AS record_number FROM s JOIN n USING (flow_id, direction) WHERE s.lo < n.hi AND n.hi - length - 5 < s.hi")
def m20_frames(spark, d):
    return R.reassemble(R.segments_of(_wire(spark, d), 200))[1].select("flow_id", "direction", "frame_number", "record_number")


@query("m18_resize_records", f"WITH {V.RECORDS} SELECT flow_id, CAST(sum(length) AS BIGINT) AS bytes FROM records GROUP BY flow_id")
def m18(spark, d):
    return R.resize_records(V.records(spark, d), 50, 3100, 7).groupBy("flow_id").agg(F.sum("length").alias("bytes"))


def header_bytes(df):
    return df.withColumn("length", F.col("length") + 5)


@query("a35_size_overhead", f"WITH {V.RECORDS}, g AS (SELECT *, record_number - row_number() OVER (PARTITION BY flow_id, content_type = 23, direction ORDER BY record_number) AS run FROM records), r AS (SELECT flow_id, content_type = 23 AS data, direction, run, count(*) AS n, sum(length) AS bytes FROM g GROUP BY ALL), f AS (SELECT flow_id, sum(bytes + 5 * n) AS before, sum(bytes + 5 * CASE WHEN data THEN ceil(bytes / 1400) ELSE n END) AS after FROM r GROUP BY flow_id) SELECT round(avg(after / before), 6) AS overhead FROM f")
def a35(spark, d):
    """Application data re-cut to records of 1,400 bytes."""
    r = V.records(spark, d)
    return size_overhead(header_bytes(r), header_bytes(R.resize_records(r, size=lambda rng, length: 1400))).withColumn("overhead", F.round("overhead", 6))


#: Upper limits of the records' sizes, and the records of a flow that are taken.
LIMITS, FIRST = [*range(100, 2**14, 1000), 2**14], 30


def _resized(spark, d, limits=LIMITS):
    """Records of each setting `hi:direction`: re-cut to at most hi bytes, or (hi 0) as they are without those of one direction."""
    r = V.records(spark, d).drop("handshake_type")
    parts = [R.resize_records(r, 50, list(limits), 1).withColumn("setting", F.concat("hi", F.lit(":0"))).drop("hi")]
    parts += [r.where(F.col("direction") != side).withColumn("setting", F.lit(f"0:{side}")) for side in (-1, 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _heads(spark, d, limits=LIMITS):
    """(setting, flow, ratio, letters) of the settings of _resized: a row for each flow and setting, none for a record."""
    rows = R.resized_heads(V.records(spark, d), 50, list(limits), 1, FIRST, MIDDLES, (-1, 1))
    return rows.select(F.concat_ws(":", "hi", "direction").alias("setting"), F.col("flow_id").alias("flow"), (F.col("after") / F.col("before")).alias("ratio"), "letters")


#: What lies between the edges of sizes.
MIDDLES = [(a + b) / 2 for a, b in zip(edges_equal(*V.BIN_EDGES), edges_equal(*V.BIN_EDGES)[1:])]


def robustness(records, before):
    """(model, scenario, hi, direction, label, accuracy, precision, recall, overhead) for each setting of the records, see `judged`."""
    letter = F.char(R.letter_of(F.when(F.col("direction") < 0, 0).otherwise(1), F.col("content_type"), nearest_edge(F.col("length"), edges_equal(*V.BIN_EDGES))))
    own = Window.partitionBy("setting", "flow_id").orderBy("record_number")
    rows = records.withColumn("place", F.row_number().over(own)).withColumn("size", F.col("length") + 5).groupBy("setting", "flow_id").agg(
        F.sum("size").alias("after"), F.array_sort(F.collect_list(F.when(F.col("place") <= FIRST, F.struct("place", letter.alias("letter"))))).alias("own")
    )
    rows = rows.join(before.groupBy("flow_id").agg(F.sum(F.col("length") + 5).alias("before")), "flow_id")
    return judged(rows.select("setting", F.col("flow_id").alias("flow"), (F.col("after") / F.col("before")).alias("ratio"), F.array_join(F.transform("own", lambda x: x["letter"]), "").alias("letters")))


def judged(flows):
    """The measures of `robustness` from (setting, flow, ratio of bytes, letters of the first records). Chains and
    profiles of all settings are fitted and scored in one job each, the setting is part of the label; equal sequences count together. The order's number mod 7
    is the label. Models take a flow's first FIRST records; the overhead is that of all."""
    label = F.concat(F.col("setting"), F.lit("|L"), (F.col("flow") % 7).cast("string")).alias("label")
    counted = flows.groupBy("setting", label, V.dset_of(F.col("flow")).alias("dset"), "letters").agg(F.count("*").alias("n"), F.sum("ratio").alias("ratio"))
    counted = materialise(counted, "heads")
    s = counted.withColumn("seq", F.split("letters", ""))
    vocab = materialise(S.vocabulary(s.where(TRAIN)), "vocabulary")
    asked = s.where(TEST).groupBy("setting", "letters", "seq").agg(F.concat_ws("|", "setting", "letters").alias("flow_id"))
    asked = materialise(S.encode(asked, vocab).repartitionByRange("setting", "letters").sortWithinPartitions("setting", F.length("letters")), "asked")
    chains = C.score_chain(asked, C.fit_chain(s.where(TRAIN), end=True, weight="n"), end=True, within="setting")
    profiles = H.phmm_score(asked, H.phmm_fit(S.encode(s, vocab), 6, vocab.count(), (1,), 2, weight="n"), "setting")
    pred = [E.arg_best(x).select("flow_id", "predicted", F.lit(name).alias("model")) for x, name in ((chains, "mc"), (profiles, "phmm"))]
    actual = s.where(TEST).select(F.concat_ws("|", "setting", "letters").alias("flow_id"), "setting", F.substring_index("label", "|", -1).alias("actual"), "n")
    day, predicted = F.concat_ws("|", "model", "setting").alias("day"), F.substring_index("predicted", "|", -1).alias("predicted")
    conf = pred[0].unionByName(pred[1]).join(actual, "flow_id").groupBy(day, "actual", predicted).agg(F.sum("n").alias("n"))
    conf = materialise(conf, "confusion")
    found = E.metrics_closed(conf).withColumn("scenario", F.lit("closed")).unionByName(E.metrics_open(conf, CLOSED).withColumn("scenario", F.lit("open")))
    found = found.withColumns({"model": F.substring_index("day", "|", 1), "setting": F.substring_index("day", "|", -1)})
    over = counted.groupBy("setting").agg((F.sum("ratio") / F.sum("n")).alias("overhead"))
    part = lambda i: F.split_part("setting", F.lit(":"), F.lit(i)).cast("int")
    return found.join(over, "setting").select("model", "scenario", part(1).alias("hi"), part(2).alias("direction"), "label", "accuracy", "precision", "recall", "overhead")


@query("m19_robustness")
def m19(spark, d):
    """18 size limits, and records of one direction not observed, x {open, closed} x {chain, profile}: re-cut, then judged."""
    return judged(_heads(spark, d))
