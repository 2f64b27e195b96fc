"""Streaming operators against a plain pass over the same rows."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlab import jobs
from flowlab.operators.hmm import Profile
from flowlab.plans import streams
from flowlab.sources import readers as R
from flowlab.streaming import ordered as O
from flowlab.streaming import stateful as ST


@pytest.fixture(scope="module")
def rows(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    e["flow_id"] = e.user_id * 100 + (e.ts.dt.day - 1) // 3
    e["t"] = e.ts.astype("datetime64[us]").astype("int64") / 1e6
    e["size"] = np.floor(e.value * 3).astype(int)
    return e


def test_admission(spark, small, rows):
    want = []
    for flow, own in rows.groupby("flow_id"):
        is_open, count, last = False, 0, 0.0
        for r in own.itertuples():
            if r.size <= 0:
                continue
            if is_open and r.t - last > 86400:
                is_open = False
            if not is_open and r.event_type == "signup":
                is_open, count = True, 0
            if is_open:
                count, last = count + 1, r.t
                want.append((flow, r.event_id, count))
                is_open = count < 4
    got = [(r.flow_id, r.frame_number, r.place) for r in streams.st1(spark, small).collect()]
    assert sorted(got) == sorted(want) and got


def plain_stream(spark, small, *columns):
    return streams.packets(spark, small).select("ts", "flow_id", "frame_number", *columns)


def test_online_profile_equals_batch(spark, small, rows):
    """The forward columns give the batch score of every prefix, for profiles of different lengths."""
    models = {"a": Profile.start(3, 3, 1), "b": Profile.start(5, 3, 2)}
    stream = plain_stream(spark, small, (F.col("tcp_length") % 3).cast("int").alias("id"))
    machine = O.OnlineProfile(models, 7, every=True)
    got = {(r.flow_id, r.place, r.model_label): r.score for r in O.run_closed(stream, "1 hour", lambda s: O.ordered(s, machine)).rows.collect()}
    want = {}
    for flow, own in rows.groupby("flow_id"):
        ids = (own["size"] % 3).tolist()[:7]
        for k, m in models.items():
            for n in range(1, len(ids) + 1):
                want[flow, n, k] = m.forward(np.array([ids[:n]]), np.array([n]))[1][0]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_record_detector_drops_out_of_sequence(spark):
    data = [(1, 1, 0.0, -1, 0, 10, 22), (1, 2, 0.1, 1, 0, 7, 22), (1, 3, 0.2, -1, 20, 5, 23), (1, 4, 0.3, -1, 10, 5, 23), (1, 5, 9.0, -1, 99, 5, 23)]
    df = spark.createDataFrame(data, "flow_id long, frame_number long, at double, direction int, tcp_seq long, tcp_len int, content_type int").withColumn("ts", F.timestamp_seconds("at"))
    got = sorted((r.frame_number, r.direction, r.size, r.at) for r in O.replay(df, O.DetectRecords(1.0)).withColumn("at", F.unix_millis("ts")).collect())
    assert got == [(-1, 0, 0, 1300), (-1, 0, 0, 10000), (1, -1, 10, 0), (2, 1, 7, 100), (4, -1, 5, 300), (5, -1, 5, 9000)]


def test_flow_documents_are_completed(spark, tmp_path):
    record = {"length": 5, "content_type": 22, "direction": 1}
    flow = {"src_ip": "a", "frames": [{"tcp_length": 9, "frame_number": 1, "time_epoch": 2.5, "direction": 1, "tls_records": [record]}], "tls_records": [record]}
    (tmp_path / "trace7.json").write_text(json.dumps(flow))
    r = R.read_flows(spark, str(tmp_path)).first()
    assert r.trace_id == "trace7" and r.total_num_frames == 1
    assert r.frames[0].tls_records[0].time_epoch == 2.5 and r.frames[0].tcp_header_length == -1


@pytest.mark.parametrize("days", [[{"A": {"A": 3, "B": 1}}, {}], {"0": {"A": {"A": 3, "B": 1}}, "1": {}}])
@pytest.mark.parametrize("name", ["conf_mats", "conf_mat"])
def test_confusions_in_either_form(spark, tmp_path, days, name):
    (tmp_path / "c.json").write_text(json.dumps({name: days}))
    got = sorted(tuple(r) for r in R.read_confusions(spark, str(tmp_path)).collect())
    assert got == [("0", "A", "A", 3), ("0", "A", "B", 1)]


def test_bad_packet_lines_are_left_out(spark, tmp_path):
    (tmp_path / "t1.csv").write_text("frame.number,time\n1,0.5,a,b,TLSv1.2,60,1,443,x\nbroken line\n2,0.6,b,a,TCP,60,443,1,y\n")
    got = R.read_packets(spark, str(tmp_path))
    assert sorted(r.frame_number for r in got.collect()) == [1, 2] and {r.trace_id for r in got.collect()} == {"t1"}


def in_files(spark, df, path, parts):
    """df as a stream of files, one a micro-batch; parts gives each row's file."""
    for i in sorted(r[0] for r in df.select(parts).distinct().collect()):
        df.where(parts == i).coalesce(1).write.parquet(f"{path}/part{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part*")


def disordered(spark, small):
    """The events as packets, each of three flows' worth of columns that any machine wants, and the files they arrive in: up to two days late."""
    f, part = streams._arriving_packets(spark, small)
    f = f.withColumns({"symbol": streams.online_symbol("tcp_len"), "id": F.pmod("tcp_len", F.lit(3)).cast("int"), "decision": F.pmod("tcp_len", F.lit(2)).cast("int")})
    return f.withColumn("part", part).persist()


MACHINES = {
    "admit": O.Admit(4, 86400.0),
    "detect": O.DetectRecords(43200.0),
    "chain": O.OnlineChain({("a", "START", "23;1;C"): 0.5, ("b", "23;1;C", "23;1;C"): 0.25}, 3, {"a": -30.0, "b": -20.0}, idle=86400.0),
    "profile": O.OnlineProfile({"a": Profile.start(3, 3, 1)}, 4, idle=86400.0),
    "votes": O.Votes(2, idle=86400.0),
}


@pytest.mark.parametrize("name", sorted(MACHINES))
@pytest.mark.parametrize("parts", [1, 5])
def test_any_split_gives_the_batch_result(spark, small, name, parts):
    rows = disordered(spark, small)
    columns = ["ts", "flow_id", *O.names_of(MACHINES[name].rows)]
    part = F.floor(F.col("part") * parts / 7) if parts == 5 else F.lit(0)
    stream = O.arriving(rows.select(*columns, part.alias("file")), F.col("file"), parts).drop("file")
    got = O.run_closed(stream, "3 days", lambda s: O.ordered(s, MACHINES[name]))
    want = O.replay(rows, MACHINES[name])
    assert got.late == 0 and got.rows.count() == want.count() > 100
    assert got.rows.exceptAll(want).count() == 0


def test_a_row_behind_the_watermark_is_dropped_and_counted(spark):
    data = [(0, 1, 1, 100.0), (0, 1, 2, 200.0), (1, 1, 3, 5000.0), (2, 1, 4, 5100.0), (3, 1, 5, 150.0), (3, 1, 6, 5050.0)]
    df = spark.createDataFrame(data, "file int, flow_id long, frame_number long, at double").select("file", F.timestamp_seconds("at").alias("ts"), "flow_id", "frame_number", F.lit(1).alias("decision"))
    ran = O.run_closed(O.arriving(df, F.col("file"), 4).drop("file"), "100 seconds", lambda s: O.ordered(s, O.Votes(5)))
    assert ran.late == 1 and [(r.flow_id, r.votes) for r in ran.rows.collect()] == [(1, 5)]


def test_a_silent_flow_ends_and_begins_anew(spark):
    data = [(1, 1, 1000.0, -1, 0, 10, 22), (2, 2, 1000.5, -1, 0, 10, 22), (2, 3, 1100.0, -1, 10, 5, 23), (3, 4, 1500.0, -1, 0, 5, 23), (3, 5, 1900.0, -1, 5, 5, 23)]
    df = spark.createDataFrame(data, "flow_id long, frame_number long, at double, direction int, tcp_seq long, tcp_len int, content_type int").withColumn("ts", F.timestamp_seconds("at"))
    for parts in (1, 6):
        got = O.run_closed(O.arriving(df, F.col("frame_number") % parts, parts), "1 second", lambda s: O.ordered(s, O.DetectRecords(1.0))).rows.collect()
        ends = sorted((r.flow_id, r.ts.timestamp() % 10000) for r in got if r.direction == 0)
        assert [flow for flow, _ in ends] == [1, 2, 2, 3, 3] and sum(r.direction != 0 for r in got) == 5


def test_chained_machines_keep_a_flow_once(spark):
    """One operator for all machines; a flow handed over in any parts gives what one machine after the other gives over all its rows."""
    rng = random.Random(3)
    edges = {(label, a, b): 0.1 + 0.2 * k for label in "xy" for k, (a, b) in enumerate([("START", "p"), ("p", "q"), ("q", "p")])}
    first, second, limits = O.Admit(9, 50.0, "symbol string"), O.OnlineChain(edges, 4, {"x": -9.0, "y": -6.0}, idle=30.0), {"x": -9.0, "y": -6.0}
    symbols, last = (lambda r: (r[0], r[1], r[4])), O.Votes(2, idle=40.0)
    decisions = lambda r: (r[0], r[1], int(r[4]))
    chained = O.Chained([first, second, last], [symbols, decisions])
    seen = 0
    for _ in range(20):
        at, rows = 0, []
        for number in range(60):
            at += rng.choice([1, 1, 1, 5, 5, 35, 60]) * 1_000_000
            rows.append((at, number, rng.choice([0, 10, 10]), rng.choice([0, 1]), rng.choice(["p", "q"])))
        want = rows
        for machine, link in ((first, lambda r: r), (second, symbols), (last, decisions)):
            want = O.advance(machine, None, [link(r) for r in want], O.NEVER - 1)[0]
        cuts = sorted(rng.sample(range(1, at), 5)) + [O.NEVER - 1]
        got, state, low = [], None, 0
        packed = O.Packed(chained.state)
        for high in cuts:
            found, state = O.advance(chained, state, [r for r in rows if low < r[0] <= high], high)
            state = None if state is None else packed.rows_of(packed.bytes_of([state]))[0]
            got, low = got + found, high
        assert got == want and state is None
        seen += len(got)
    assert seen > 20
    stream = O.arriving(streams._arriving_packets(spark, "/root/testdata/sf0.001")[0], F.lit(0), 1).withWatermark("ts", "1 day")
    plan = O.classify_packets(stream, edges, 4, limits, streams.online_symbol(), 12)._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithState") == 1


def test_online_classification_equals_its_batch_twin(spark, small):
    """Four machines in one query over files in disorder, against the same over the table and against jobs.online_classify."""
    got = streams.st10(spark, small)
    table, limits = streams._chains(spark, small)
    rows, _ = streams._arriving_packets(spark, small)
    want = O.classify_table(rows, table, 4, limits, streams.online_symbol(), 12, 86400.0, 43200.0).drop("ts")
    assert got.count() == want.count() > 100 and got.exceptAll(want).count() == 0
    edges = spark.createDataFrame([(*k, v) for k, v in table.items()], "label string, tail string, head string, prob double")
    model = "ano", (edges, spark.createDataFrame(list(limits.items()), "model_label string, threshold double"))
    assert jobs.online_classify(rows, model, 4, streams.online_symbol(), 12, 86400.0, 43200.0).drop("ts").exceptAll(want).count() == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    data = [(1, "a", 100), (1, "b", 110), (2, "a", 7200), (3, "a", 7250), (4, "a", 105), (4, "b", 7300), (5, "b", 20000)]
    df = spark.createDataFrame(data, "file int, kind string, at long").withColumn("ts", F.timestamp_seconds("at"))
    got, late = ST.run_counted(ST.late_counts(in_files(spark, df, tmp_path, F.col("file")), "10 minutes", "1 hour", "kind"))
    assert late == 1
    assert sorted((r.start.timestamp() if r.start.tzinfo else r.at, r.kind, r.n) for r in got.select("start", F.unix_timestamp("start").alias("at"), "kind", "n").collect()) == [(0, "a", 1), (0, "b", 1), (7200, "a", 2), (7200, "b", 1)]


class Store:
    """A state store that counts its calls."""

    def __init__(self):
        self.calls, self.values = 0, {}

    def getValueState(self, name, schema):
        return Kept(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer
    getCurrentWatermarkInMs = lambda self: 10**12


class Kept:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _call(self, value=None, keep=False):
        self.store.calls += 1
        if keep:
            self.store.values[self.name] = value
        return self.store.values.get(self.name)

    get = _call
    exists = lambda self: self._call() is not None
    put = update = lambda self, value: self._call(value, True)
    clear = lambda self: self._call(None, True)
    appendValue = lambda self, value: self._call([*(self.store.values.get(self.name) or []), value], True)


def test_state_calls_do_not_grow_with_flows():
    calls = {}
    for flows in (1, 300):
        store, machine = Store(), O.InOrder(O.Votes(2), "bigint")
        machine.init(store)
        frame = pd.DataFrame([(f, f * 10 + i, f * 10 + i, f % 2) for f in range(flows) for i in range(2)], columns=["flow_id", "at", "frame_number", "decision"])
        machine.handleInputRows((0,), iter([frame]), None)
        out = pd.concat(machine.handleExpiredTimer((0,), store, None))
        assert dict(zip(out["flow_id"], out["votes"])) == {f: 2 * (f % 2) for f in range(flows)}
        calls[flows] = store.calls
    assert calls[1] == calls[300]
