"""End-to-end jobs: what a user calls. Each takes and returns DataFrames; the parts are in flowlab.operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions import symbols as Y
from flowlab.operators import aggregates as A
from flowlab.operators import chains as C
from flowlab.operators import evaluation as E
from flowlab.operators import hmm as H
from flowlab.operators import ipset as I
from flowlab.operators import joins as J
from flowlab.operators import learning as L
from flowlab.operators import nfstats as N
from flowlab.operators import reassembly as R
from flowlab.operators import selection as P
from flowlab.operators import similarity as S
from flowlab.operators import windows as W
from flowlab.sources import writers as K
from flowlab.sources.storage import materialise
from flowlab.streaming import ordered as O


@dataclass(frozen=True)
class Kind:
    """A classifier: fit(train) gives a model of DataFrames; predict(model, test) gives (flow_id, predicted); score(model, test), where
    there is one, (flow_id, model_label, score), larger for a likelier label."""

    fit: Callable
    predict: Callable
    score: Callable | None = None


def _coded(seqs: DataFrame, vocab: DataFrame) -> DataFrame:
    return S.encode(seqs, vocab)


def _profile_fit(train: DataFrame, length: int = 6, seeds=(1,), iterations: int = 2):
    vocab = S.vocabulary(train).persist()
    rows = _coded(train, vocab)
    rows = rows if "dset" in rows.columns else rows.withColumn("dset", F.lit("train"))
    return vocab, H.phmm_fit(rows, length, vocab.count(), seeds, iterations)


def _dense_fit(train: DataFrame, states: int = 3, iterations: int = 2):
    vocab = S.vocabulary(train).persist()
    return vocab, H.hmm_fit(_coded(train, vocab), states, vocab.count(), iterations=iterations)


def _anomaly_fit(train: DataFrame):
    edges = C.fit_chain(train)
    scores = C.score_chain(train, edges).join(train.select("flow_id", "label"), "flow_id")
    return edges, E.thresholds(scores.where(F.col("label") == F.col("model_label")))


def _knn_fit(train: DataFrame, k: int = 9, fraction: float | None = None):
    vocab = S.vocabulary(train).persist()
    return vocab, _coded(train, vocab).select("flow_id", "label", "word"), k, fraction


def _knn_rows(model, test: DataFrame) -> DataFrame:
    vocab, train, k, _ = model
    return S.nearest(_coded(test, vocab), train, k)


def _vote_shares(neighbours: DataFrame) -> DataFrame:
    rows = neighbours.groupBy(F.col("id").alias("flow_id"), F.col("label").alias("model_label")).agg(F.count("*").alias("n"))
    return rows.select("flow_id", "model_label", (F.col("n") / F.sum("n").over(Window.partitionBy("flow_id"))).alias("score"))


def _ipset_fit(train: DataFrame, hosts: DataFrame):
    return (*I.ip_sets(train, hosts), I.entropies(train)[1], hosts)


def _ipset_score(model, test: DataFrame) -> DataFrame:
    primary, secondary, entropy, hosts = model
    pages = test.join(hosts.select("url_id", "host"), "url_id").select("load", "ip", (F.col("domain") == F.col("host")).alias("is_primary")).distinct()
    return I.score_ipset(pages, primary, secondary, entropy).select(F.col("load").alias("flow_id"), F.col("label").alias("model_label"), "score")


def _ipset_predict(model, test: DataFrame) -> DataFrame:
    scores = _ipset_score(model, test).withColumnsRenamed({"flow_id": "load", "model_label": "label"})
    return I.ipset_classify(scores).select(F.col("load").alias("flow_id"), "predicted")


def _scored(fit: Callable, score: Callable) -> Kind:
    return Kind(fit, lambda m, test: E.arg_best(score(m, test)), score)


#: Classifiers by name. Sequences are rows (flow_id, label, seq); those of `cumul` have `features` and `day` instead, those of `ipset` are
#: resolutions (load, url_id, domain, ip), with the labels and hosts of urls (url_id, label, host) as a setting.
KINDS: dict[str, Kind] = {
    "knn": Kind(_knn_fit, lambda m, test: S.knn(m[1], _coded(test, m[0]), m[2], m[3]).select(F.col("id").alias("flow_id"), "predicted"), lambda m, test: _vote_shares(_knn_rows(m, test))),
    "mc1": _scored(lambda train: C.fit_chain(train, end=True), lambda m, test: C.score_chain(test, m, end=True)),
    "mc2": _scored(C.fit_chain2, lambda m, test: C.score_chain2(test, *m)),
    "phmm": _scored(_profile_fit, lambda m, test: H.phmm_score(_coded(test, m[0]), m[1])),
    "hmm": _scored(_dense_fit, lambda m, test: H.hmm_score(_coded(test, m[0]), m[1])),
    "ano": Kind(_anomaly_fit, lambda m, test: C.ensemble(C.score_chain(test, m[0]), m[1]), lambda m, test: C.score_chain(test, m[0])),
    "cumul": Kind(lambda train, **settings: (materialise(train, "cumul"), settings), lambda m, test: L.cumul_classify(m[0], test, **m[1])),
    "ipset": Kind(_ipset_fit, _ipset_predict, _ipset_score),
}


def register(name: str, fit: Callable, predict: Callable, score: Callable | None = None) -> None:
    """Add a classifier of one's own to those that `train`, `classify` and `scores` know."""
    KINDS[name] = Kind(fit, predict, score)


def train(kind: str, rows: DataFrame, **settings):
    """A fitted model of a kind."""
    if kind not in KINDS:
        raise ValueError(f"no classifier {kind!r}: there are {', '.join(sorted(KINDS))}")
    return kind, KINDS[kind].fit(rows, **settings)


def classify(model, rows: DataFrame, defense: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(flow_id, predicted) of rows under a model of `train`. `defense` is applied to the rows first: what a flow's owner
    does to hide it."""
    kind, own = model
    return KINDS[kind].predict(own, rows if defense is None else defense(rows)).select("flow_id", "predicted")


def scores(model, rows: DataFrame, defense: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(flow_id, model_label, score) of rows under a model of `train`: logarithms of likelihoods, shares of votes, sums of entropies."""
    kind, own = model
    if KINDS[kind].score is None:
        raise ValueError(f"{kind!r} has labels, not scores")
    return KINDS[kind].score(own, rows if defense is None else defense(rows)).select("flow_id", "model_label", "score")


def evaluate(predicted: DataFrame, truth: DataFrame, closed=None, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Metrics per day and label of (flow_id, predicted) against (flow_id, label, day): closed world, or, given the closed labels,
    open world. `change` is applied to the confusion counts (day, actual, predicted, n) first."""
    conf = E.confusion(predicted.join(truth.select("flow_id", "day", F.col("label").alias("actual")), "flow_id"))
    conf = conf if change is None else change(conf)
    return E.metrics_closed(conf) if closed is None else E.metrics_open(conf, closed)


def evaluation(predicted: DataFrame, truth: DataFrame, closed=None, change=None, level: float = 0.95, b: int = 1000, seed: int = 1) -> dict[str, DataFrame]:
    """All of an evaluation: `metrics` per day and label as of `evaluate`, `weighted` scores per day, `by_day` and `by_label` means and
    medians of the metrics, and `intervals` of each day's share of right labels by bootstrap."""
    rows = predicted.join(truth.select("flow_id", "day", F.col("label").alias("actual")), "flow_id")
    conf = materialise(E.confusion(rows), "confusion")
    conf = conf if change is None else change(conf)
    metrics = E.metrics_closed(conf) if closed is None else E.metrics_open(conf, closed)
    seen = lambda c: F.col(c) if closed is None else F.when(F.col(c).isin(*closed), F.col(c)).otherwise("unknown")
    right = rows.select("day", (seen("actual") == seen("predicted")).cast("double").alias("right"))
    merged = conf.select("day", seen("actual").alias("actual"), seen("predicted").alias("predicted"), "n").groupBy("day", "actual", "predicted").agg(F.sum("n").alias("n"))
    return {"metrics": metrics, "weighted": E.weighted_scores(merged), "by_day": E.macro(metrics, "day"), "by_label": E.macro(metrics, "label"), "intervals": A.bootstrap_ci(right, "day", "right", level, b, seed)}


def choose(trials: DataFrame, by, steps, value: str) -> dict[str, DataFrame]:
    """`stats` of the trials of each group, and the `best` after successive choices (column, largest wins, tolerance)."""
    return {"stats": E.trial_stats(trials, by, value), "best": E.best_trial(trials, by, steps)}


def flows_from_packets(packets: DataFrame, segments: DataFrame | None = None) -> dict[str, DataFrame]:
    """`packets` of each trace's main flow: that of the first ClientHello to the first address; `records`, the TLS records of the segments
    (flow_id, direction, frame_number, tcp_seq, tcp_len, payload) without retransmissions and what follows a gap, and `inside`, the records in frames;
    `failures` (trace_id, reason): traces without a main flow. Without `segments` those are the main packets themselves, which then have
    tcp_seq and payload."""
    hello = P.client_hellos(packets)
    address = hello.groupBy("trace_id").agg(F.min_by("ip_dst", "frame_number").alias("address"))
    main = J.main_flow_packets(packets, address)
    if segments is None:
        segments = main.drop("address").join(address, "trace_id").select(F.col("trace_id").alias("flow_id"), F.when(F.col("ip_dst") == F.col("address"), -1).otherwise(1).alias("direction"), "frame_number", "tcp_seq", "tcp_len", "payload")
    records, inside = R.reassemble(W.cut_at_gap(W.drop_retransmissions(segments)))
    traces = packets.select("trace_id").distinct()
    greeted = hello.select("trace_id").distinct().withColumn("greeted", F.lit(True))
    failures = traces.join(main.select("trace_id").distinct(), "trace_id", "left_anti").join(greeted, "trace_id", "left")
    failures = failures.select("trace_id", F.when(F.col("greeted"), "no main flow").otherwise("no ClientHello").alias("reason"))
    return {"packets": main, "records": records, "inside": inside, "failures": failures}


#: Element kinds by name: the symbol of a row of frames (tcp_length, tls_records) or records (length, content_type, handshake_type).
ELEMENTS: dict[str, Callable] = {
    "frame": lambda edges: Y.frame_symbol(F.col("direction"), F.col("tcp_length"), F.col("tls_records"), edges),
    "record": lambda edges: Y.record_symbol(F.col("direction"), F.col("length"), F.col("content_type"), F.col("handshake_type"), edges),
}


def sequences(rows: DataFrame, element: str = "record", edges=None, keep=(), order: str = "record_number", length: int | None = None) -> DataFrame:
    """(flow_id, keep..., seq): sequences of the elements of a kind, in `order`; the first `length` of them."""
    if element not in ELEMENTS:
        raise ValueError(f"no element kind {element!r}: there are {', '.join(sorted(ELEMENTS))}")
    own = rows.select("flow_id", *keep, F.col(order).alias("__at"), ELEMENTS[element](edges).alias("__s"))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__s"))), lambda x: x["__s"])
    return own.groupBy("flow_id", *keep).agg((seq if length is None else Y.pad_and_cut(seq, length)).alias("seq"))


def dataset(traces: DataFrame, urls: DataFrame, sequences: DataFrame, closed, length: int | None = None, day: str | None = None, one_unknown: bool = False, per_label: int | None = None, split: tuple[int, int] | None = None, seed: int = 1, path: str | None = None) -> DataFrame:
    """Rows (flow_id, label, day, dset, seq, ...) of the successful traces that have sequences: labels outside the closed set are
    `unknown`, sequences are cut after `length` elements.

    day: the column of traces whose distinct days are numbered as `day`. one_unknown: of each label outside the closed set only the first
    trace of a day (needs day). per_label: at most so many rows of each label, by a seeded hash. split: (test, validation) urls of
    each label, the rest is for training; all rows of a url stay together. path: the rows are written there, a folder for each set and label, and read
    back."""
    rows = J.traces_with_urls(traces.where("was_successful"), urls).withColumnRenamed("id", "flow_id")
    if day is not None:
        rows = W.day_index(rows.drop("day"), day).withColumnRenamed("day_index", "day")
    rows = rows.select("flow_id", "address", *["day"] * (day is not None)).join(sequences, "flow_id")
    if one_unknown:
        rows = W.one_unknown_per_day(rows.withColumn("id", F.col("flow_id")), closed).drop("id")
    rows = rows.withColumn("label", F.when(F.col("label").isin(*closed), F.col("label")).otherwise("unknown"))
    if per_label is not None:
        rows = P.sample_per_label(rows, per_label, seed)
    if split is not None:
        named = W.split(rows.drop("dset").withColumns({"tag": F.col("label"), "url": F.col("address")}), *split, seed=str(seed))
        rows = named.drop("tag", "url")
    rows = rows if length is None else rows.withColumn("seq", F.slice("seq", 1, length))
    if path is None:
        return rows
    K.write_dataset(rows, path)
    return rows.sparkSession.read.parquet(path)


def flow_stats(frames: DataFrame, until: float | None = None) -> DataFrame:
    """Per flow and label: frames, and the eight-number summary of their sizes; up to `until` seconds after a flow's start."""
    if until is not None:
        start = frames.groupBy("flow_id").agg(F.min("time_epoch").alias("start"))
        frames = frames.join(start, "flow_id").where(F.col("time_epoch") <= F.col("start") + until).drop("start")
    counts = A.frame_counts(frames)
    return frames.select("flow_id", "label").distinct().join(counts, "flow_id").join(A.summary8(frames, "flow_id", "tcp_length"), "flow_id")


def flow_report(frames: DataFrame, records: DataFrame | None = None, packets: DataFrame | None = None, until: float | None = None) -> dict[str, DataFrame]:
    """Statistics of flows: `flows` (flow_stats), `handshakes`, `sizes` (size lists), `cdf` of frame sizes; with records their `types`, with packets
    their `conversations` and the `traces` they add up to."""
    out = {"flows": flow_stats(frames, until), "handshakes": A.handshake_counts(frames), "sizes": A.size_lists(frames), "cdf": A.ecdf(frames, "tcp_length")}
    if records is not None:
        out["types"] = A.sizes_by_type(records)
    if packets is not None:
        out["conversations"] = A.conversations(packets)
        out["traces"] = A.trace_rollup(out["conversations"])
    return out


def similarity(words: DataFrame) -> dict[str, DataFrame]:
    """Of rows (flow_id, label, word): `pairs` of labels, their `summary`, the `matrix` of mean distances and each label's
    `median` sequence."""
    pairs = S.label_pairs(words)
    return {"pairs": pairs, "summary": S.similarity_summary(pairs), "matrix": S.distance_matrix(pairs), "median": S.median_sequence(words)}


def online_classify(packets: DataFrame, model, n: int, symbol, max_packets: int, idle: float = 5.0, pause: float = 1.0) -> DataFrame:
    """(ts, flow_id, label, votes, enter, seconds) of a stream of packets with a watermark on ts (flow_id, frame_number, payload_len,
    handshake_type, direction, tcp_seq, tcp_len, content_type): admission, record detection, symbols, the chains of an `ano` model after n symbols or at
    the flow's end, and the fan-in of their decisions, with the time since the flow's admission. `symbol` makes a symbol of direction, size and
    content_type. A model has a row for each label and pair of symbols and goes to the tasks. A table of packets gives what the stream does."""
    kind, (edges, limits) = model
    table = {(r.label, r.tail, r.head): r.prob for r in edges.collect()}
    run = O.classify_packets if packets.isStreaming else O.classify_table
    return run(packets, table, n, {r.model_label: r.threshold for r in limits.collect()}, symbol, max_packets, idle, pause)


def nf_report(stats: DataFrame, ttl: DataFrame | None = None, limit: int = 1000, skip: int = 3, instance: int = 1) -> dict[str, DataFrame]:
    """Of a network function's counters (serviceid, ts, rx, cost, drop, models, run, ...): `differences`, `cost` per packet, the `slice` of
    the experiment, the runs with `drops`, and the `capacity`: the most models before a run drops. ttl (delta): the `latency` too."""
    runs = N.drops(stats.withColumn("__run", F.struct("run", "models")), limit, skip, "__run").select("__run.*", "dropped")
    out = {
        "differences": W.diffs(stats, "serviceid", "n", ["rx", "cost"]), "cost": N.cost_per_packet(stats), "slice": W.experiment_slice(stats, instance),
        "drops": runs, "capacity": N.capacity(runs, "run"),
    }
    return out if ttl is None else out | {"latency": N.latency_summary(ttl)}
