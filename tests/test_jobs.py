"""End-to-end jobs and hooks; operators that SQL can't express against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab import jobs
from flowlab.operators import aggregates as A
from flowlab.operators import hmm as H
from flowlab.operators import learning as L
from flowlab.operators import learning as L
from flowlab.operators import reassembly as R
from flowlab.operators import similarity as S
from flowlab.plans import models
from flowlab.plans import views as V
from flowlab.sources import writers as K


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        label = "xy"[i % 2]
        rows.append((i, label, i % 3, "train" if i < 90 else "test", ["abcd"[k] for k in rng.choice(4, 12, p=[0.6, 0.2, 0.1, 0.1] if label == "x" else [0.1, 0.1, 0.2, 0.6])]))
    df = spark.createDataFrame(rows, "flow_id long, label string, day int, dset string, seq array<string>").persist()
    return df.where("dset = 'train'"), df.where("dset = 'test'")


@pytest.mark.parametrize("kind, settings", [("knn", {"k": 5}), ("mc1", {}), ("mc2", {}), ("phmm", {"length": 4}), ("hmm", {"states": 2}), ("ano", {})])
def test_train_and_classify(split, kind, settings):
    train, test = split
    got = jobs.classify(jobs.train(kind, train, **settings), test)
    assert got.columns == ["flow_id", "predicted"] and got.count() == 30
    right = got.join(test, "flow_id").where("label = predicted").count() / 30
    assert right >= (0.5 if kind == "ano" else 0.8)


def test_cumulative_classifier(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, "ab"[i % 2], rng.normal(3 * (i % 2), 1, 4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "flow_id long, day int, label string, features array<double>")
    model = jobs.train("cumul", df.where("flow_id < 90"), n_in=4, n_out=64)
    got = jobs.classify(model, df.where("flow_id >= 90")).join(df, "flow_id")
    assert got.count() == 30 and got.where("label = predicted").count() >= 27


def test_cumulative_query_sees_what_lies_between_ten_points(spark, monkeypatch):
    """Flows of two labels differ in the order of two neighbouring frames only, far from each tenth of a flow."""
    sets = ["train"] * 6 + ["test"] * 2
    rows = [(i, "ab"[i % 2], i % 3, sets[i // 2 % 8], j + 1, (900 + i if j == 15 + i % 2 else 20), 1) for i in range(64) for j in range(100)]
    frames = spark.createDataFrame(rows, "flow_id long, label string, day int, dset string, frame_number int, tcp_length int, direction int")
    monkeypatch.setattr(models.V, "frames", lambda *_: frames)
    got = models.m10(spark, "").collect()
    assert len(got) == 16 and sum(r.actual == r.predicted for r in got) >= 14


def test_fourier_features_are_the_kernel(spark):
    x = np.random.default_rng(5).uniform(-1, 1, (40, 6))
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "i int, features array<double>")
    lo, hi = L.feature_bounds(df)
    assert lo == x.min(axis=0).tolist() and hi == x.max(axis=0).tolist()
    z = np.array([r.z for r in df.select("i", L.fourier_features("features", lo, hi, 512, 0.1, 1).alias("z")).orderBy("i").collect()])
    y = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0)) * 2 - 1
    kernel = np.exp(-0.1 * ((y[:, None] - y[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).mean() < 0.04


def test_own_classifier_defence_and_changed_counts(split):
    train, test = split
    jobs.register("first", lambda rows: None, lambda m, rows: rows.withColumn("predicted", F.when(F.col("seq")[0] == "a", "x").otherwise("y")))
    plain = jobs.classify(jobs.train("first", train), test)
    hidden = jobs.classify(jobs.train("first", train), test, defense=lambda rows: rows.withColumn("seq", F.transform("seq", lambda s: F.lit("a"))))
    assert {r.predicted for r in plain.collect()} == {"x", "y"} and {r.predicted for r in hidden.collect()} == {"x"}
    closed = jobs.evaluate(plain, test)
    assert {r.label for r in closed.collect()} == {"x", "y"}
    opened = jobs.evaluate(plain, test, closed=["x"], change=lambda conf: conf.withColumn("day", F.lit(0)))
    assert {(r.day, r.label) for r in opened.collect()} == {(0, "x"), (0, "unknown")}
    with pytest.raises(ValueError):
        jobs.train("none", train)


def test_other_jobs(spark, small, split):
    assert jobs.flow_stats(V.frames(spark, small), 3600).count() == V.frames(spark, small).select("flow_id").distinct().count()
    found = jobs.similarity(V.words(spark, small).where("dset = 'val'"))
    assert all(df.count() > 0 for df in found.values())
    assert all(df.count() > 0 for df in jobs.nf_report(V.nf_stats(spark, small)).values())
    cat = V.catalog(spark, small)
    seqs = V.records(spark, small).groupBy("flow_id").agg(F.collect_list("length").alias("seq")).withColumn("label", F.concat(F.lit("L"), (F.col("flow_id") % 3).cast("string")))
    rows = jobs.dataset(cat["traces_metadata"], cat["urls"], seqs, ["L0"], 3).select("label", F.size("seq").alias("n")).collect()
    assert {r.label for r in rows} == {"L0", "unknown"} and max(r.n for r in rows) == 3
    wire = R.segments_of(models._wire(spark, small).where("flow_id < 200"), 200)
    packets = V.packets(spark, small)
    found = jobs.flows_from_packets(packets, wire)
    assert found["packets"].count() > 0 and found["records"].count() > 0 and found["inside"].count() >= found["records"].count()
    traces = {r.trace_id for r in packets.select("trace_id").distinct().collect()}
    assert {r.trace_id for r in found["failures"].collect()} == traces - {r.trace_id for r in found["packets"].select("trace_id").distinct().collect()}
    report = jobs.flow_report(V.frames(spark, small), V.records(spark, small), packets, 3600)
    assert all(df.count() > 0 for df in report.values()) and len(report) == 7


def test_flows_of_packets_alone(spark):
    """Segments are the packets themselves: a record cut over two of them, a retransmission; a trace without a ClientHello is a failure."""
    hello, data = bytes([22, 3, 3, 0, 4]) + b"abcd", bytes([23, 3, 3, 0, 6]) + b"efghij"
    rows = [("t", 1, "c", "s", 1, 443, "TLSv1.2", "Client Hello", 1, 0, hello[:6]), ("t", 2, "c", "s", 1, 443, "TLSv1.2", "", None, 0, hello[:6]), ("t", 3, "c", "s", 1, 443, "TLSv1.2", "", None, 6, hello[6:] + data), ("t", 4, "s", "c", 443, 1, "TLSv1.2", "", None, 0, data), ("u", 1, "c", "s", 2, 443, "TCP", "", None, 0, b"x")]
    df = spark.createDataFrame([(*r[:10], bytearray(r[10]), len(r[10])) for r in rows], "trace_id string, frame_number long, ip_src string, ip_dst string, tcp_srcport int, tcp_dstport int, protocol string, info string, handshake_type int, tcp_seq long, payload binary, tcp_len int")
    found = jobs.flows_from_packets(df)
    assert sorted((r.direction, r.record_number, r.content_type, r.length) for r in found["records"].collect()) == [(-1, 0, 22, 4), (-1, 1, 23, 6), (1, 0, 23, 6)]
    assert [tuple(r) for r in found["failures"].collect()] == [("u", "no ClientHello")]


def test_dataset_with_splits_and_sink(spark, small, tmp_path):
    cat = V.catalog(spark, small)
    labelled = lambda df: df.withColumn("label", F.concat(F.lit("L"), (F.col("flow_id") % 5).cast("string")))
    rows = labelled(V.records(spark, small))
    seqs = jobs.sequences(rows, "record", [0, 3000, 9000], keep=["label"], length=3)
    first = {r.flow_id: r.seq for r in seqs.collect()}
    one = next(k for k, v in first.items() if len(v) == 3 and "0" not in v)
    sizes = [r for r in rows.where(F.col("flow_id") == one).orderBy("record_number").limit(3).collect()]
    edge = lambda n: min(range(3), key=lambda i: (abs((0, 3000, 9000)[i] - n), i))
    assert first[one] == [f"{r.content_type}{':%d' % r.handshake_type if r.handshake_type is not None else ''};{edge(r.length)};{'C' if r.direction < 0 else 'S'}" for r in sizes]
    with pytest.raises(ValueError):
        jobs.sequences(rows, "packet")
    out = jobs.dataset(cat["traces_metadata"], cat["urls"], seqs, ["L0", "L1"], day="start_capture", one_unknown=True, per_label=60, split=(4, 3), path=f"{tmp_path}/set").toPandas()
    assert set(out.label) == {"L0", "L1", "unknown"} and set(out.dset) == {"train", "val", "test"} and out.groupby("label").size().max() <= 60
    assert out.groupby(["label", "address"]).dset.nunique().max() == 1
    assert out[out.dset == "test"].groupby("label").address.nunique().max() <= 4
    days = sorted(r[0] for r in cat["traces_metadata"].where("was_successful").select("start_capture").distinct().collect())
    when = {r.id: r.start_capture for r in cat["traces_metadata"].collect()}
    assert all(days[r.day] == when[r.flow_id] for r in out.itertuples())
    unknown = jobs.dataset(cat["traces_metadata"], cat["urls"], seqs, ["L0", "L1"], day="start_capture", one_unknown=True).where("label = 'unknown'").toPandas()
    assert len(unknown) <= 3 * unknown.day.nunique() and not unknown.flow_id.duplicated().any()


def test_scores_of_kinds(split):
    train, test = split
    for kind, settings in (("knn", {"k": 5}), ("mc1", {}), ("mc2", {}), ("ano", {})):
        model = jobs.train(kind, train, **settings)
        found = jobs.scores(model, test)
        best = {r.flow_id: (r.score, r.model_label) for r in found.orderBy("score").collect()}
        told = {r.flow_id: r.predicted for r in jobs.classify(model, test).collect()}
        assert best.keys() == told.keys() and (kind == "ano" or sum(best[k][1] == told[k] for k in told) >= 29)
    jobs.register("labels only", lambda rows: None, lambda m, rows: rows)
    with pytest.raises(ValueError):
        jobs.scores(jobs.train("labels only", train), test)


def test_ipset_kind(spark, small):
    from flowlab.plans import captures

    r, hosts = V.resolutions(spark, small), captures._hosts(spark)
    model = jobs.train("ipset", r.where("load % 10 < 8"), hosts=hosts)
    test = r.where("load % 10 >= 8")
    told = {x.flow_id: x.predicted for x in jobs.classify(model, test).collect()}
    scores = {}
    for x in jobs.scores(model, test).collect():
        scores.setdefault(x.flow_id, []).append((-round(x.score, 9), x.model_label))
    assert told == {k: min(v)[1] for k, v in scores.items()} and told


def test_evaluation_and_choice(spark, split):
    _, test = split
    predicted = test.select("flow_id", F.when(F.col("flow_id") % 5 == 0, "x").otherwise(F.col("label")).alias("predicted"))
    found = jobs.evaluation(predicted, test, b=200)
    rows = test.select("flow_id", "day", "label").toPandas().merge(predicted.toPandas())
    for r in found["weighted"].collect():
        own = rows[rows.day == r.day]
        assert r.accuracy == pytest.approx((own.label == own.predicted).mean())
    for r in found["intervals"].collect():
        assert r["mean"] == pytest.approx((rows[rows.day == r.day].eval("label == predicted")).mean()) and r.low <= r["mean"] <= r.high
    assert {r.day for r in found["by_day"].collect()} == {0, 1, 2} and {r.label for r in found["by_label"].collect()} == {"x", "y"}
    opened = jobs.evaluation(predicted, test, closed=["x"], b=50)
    assert {r.label for r in opened["metrics"].collect()} == {"x", "unknown"}
    trials = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.9), ("a", 3, 0.5), ("b", 4, 0.2)], "kind string, size int, accuracy double")
    chosen = jobs.choose(trials, ["kind"], [("accuracy", True, 0.01), ("size", False, 0)], "accuracy")
    assert sorted((r.kind, r["size"]) for r in chosen["best"].collect()) == [("a", 1), ("b", 4)] and chosen["stats"].count() == 2


def test_network_function_report(spark, small):
    stats = V.nf_stats(spark, small)
    found = jobs.nf_report(stats, spark.createDataFrame([(1.0,), (3.0,)], "delta double"), limit=3, skip=2)
    assert found["latency"].first()["mean"] == 2.0
    runs = {(r.run, r.models): r.dropped for r in found["drops"].collect()}
    rows = stats.toPandas()
    assert runs == {k: bool((g[g.serviceid >= 2]["drop"].max() if (g.serviceid >= 2).any() else 0) > 3) for k, g in rows.groupby(["run", "models"])}
    assert {r.run for r in found["capacity"].collect()} == {k[0] for k in runs}


def test_predictions_once(spark, tmp_path):
    rows = [(i, f"p{i}", {"a": 0.5}) for i in range(20)]
    df = spark.createDataFrame(rows, "flow_id long, predicted string, scores map<string,double>")
    for _ in range(2):
        K.write_predictions(df, f"{tmp_path}/batch", 3)
    K.write_predictions(df.where("flow_id < 5").withColumn("predicted", F.lit("new")), f"{tmp_path}/batch", 10)
    got = {r.flow_id: (r.predicted, r.scores, r.scores_json) for r in K.read_predictions(spark, f"{tmp_path}/batch").collect()}
    assert got == {i: ("new" if i < 5 else f"p{i}", {"a": 0.5}, '{"a":0.5}') for i in range(20)}
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    for run in ("one", "two"):  # the second starts anew, as if its checkpoint were lost
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        K.stream_predictions(stream, f"{tmp_path}/stream", f"{tmp_path}/{run}").awaitTermination()
    assert sorted(r.flow_id for r in K.read_predictions(spark, f"{tmp_path}/stream").collect()) == list(range(20)) and spark.read.parquet(f"{tmp_path}/stream").count() == 20


def test_size_generator(spark):
    rows = [(1, n, -1, 23 if n else 22, size) for n, size in enumerate((70, 100, 300))]
    df = spark.createDataFrame(rows, "flow_id long, record_number int, direction int, content_type int, length int")
    got = R.resize_records(df, size=lambda rng, length: length // 2).collect()
    # halves of the record that is being cut: 50 50 of 100, then 150 150
    assert [(r.content_type, r.length) for r in sorted(got, key=lambda r: r.record_number)] == [(22, 70), (23, 50), (23, 50), (23, 150), (23, 150)]


def test_bootstrap_of_other_statistics(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("k", float(v)) for v in rng.normal(10, 2, 400)], "k string, v double")
    spread = lambda v, w: F.sqrt(F.sum(v * v * w) / F.sum(w) - F.pow(F.sum(v * w) / F.sum(w), 2))
    ci = A.bootstrap_ci(df, "k", "v", b=200, statistic=spread).first()
    assert ci.low < 2.2 and ci.high > 1.8 and ci.low < ci["mean"] < ci.high
    half = lambda v, w: F.percentile(v, 0.5, w)
    assert A.bootstrap_ci(df, "k", "v", b=100, statistic=half).first()["mean"] == pytest.approx(float(np.median([r.v for r in df.collect()])))
    p = {side: A.bootstrap_test(df, "k", "v", 9.5, b=200, side=side).first().p for side in ("less", "greater", "both")}
    assert p["greater"] < 0.05 < 0.9 < p["less"] and p["both"] <= 2 * p["greater"] + 1e-9


def test_dense_model_sums_over_all_paths():
    m = H.Dense.start(2, 3, 5)
    for seq in ([0], [2, 1], [0, 1, 1, 2], [1, -1, 0]):
        want = 0.0
        for path in itertools.product(range(2), repeat=len(seq)):
            p = m.pi[path[0]]
            for a, b in itertools.pairwise(path):
                p *= m.a[a, b]
            for state, s in zip(path, seq):
                p *= m.e[state, s] if s >= 0 else H.UNKNOWN
            want += p
        assert m.forward(seq)[1].sum() == pytest.approx(math.log(want))


def test_dense_fit_gets_better(spark):
    rows = [(i, "x", [0, 1] * 5 if i % 2 else [1, 0] * 5) for i in range(10)]
    df = spark.createDataFrame(rows, "flow_id long, label string, ids array<int>")
    total = [H.hmm_score(df, H.hmm_fit(df, 2, 2, iterations=n)).agg(F.sum("score")).first()[0] for n in (1, 8)]
    assert total[1] > total[0]


def test_profile_from_alignment(spark):
    w = spark.createDataFrame([(i, "x", t) for i, t in enumerate(["abc", "abc", "abc", "ac", "abbc"])], "flow_id long, label string, word string")
    medians = S.median_sequence(w)
    own = H.profile_from_alignment(H.alignment_counts(w, medians), medians, 4)["x"]
    assert medians.first().word == "abc" and np.allclose(own.t[own.t.sum(axis=2) > 0].sum(axis=-1), 1)


def test_edges_are_means_of_their_values(spark):
    values = [1.0, 2.0, 2.0, 3.0, 50.0, 52.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values * 3], "size double")
    got = L.edges_kmeans(df, "size", 3)
    near = {c: [v for v in values if min(got, key=lambda x: abs(x - v)) == c] for c in got}
    assert got == pytest.approx([sum(v) / len(v) for v in near.values()]) and got == pytest.approx([2, 51, 100])


def test_best_clustering(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([("ab"[i % 2], (rng.normal(0, 0.2, 2) + 4 * (i % 2)).tolist()) for i in range(60)], "label string, v array<double>")
    got = L.best_clustering(points, [2, 3]).first()
    assert got.k in (2, 3) and got["product"] == pytest.approx(got.spva * got.spvc)


def test_importance(spark):
    rows = [(m, b, float(3 * b + (i % 3) * 0.01)) for i, (m, b) in enumerate(itertools.product("pq" * 10, range(5)))]
    got = {r.name: r.importance for r in L.hyperparameter_importance(spark.createDataFrame(rows, "m string, b int, y double"), ["m", "b"], "y").collect()}
    assert sum(got.values()) == pytest.approx(1) and got["b"] > 0.8
