"""State machines over flows whose rows may come in any order within the watermark's delay.

A row waits in its flow's state until the watermark has passed its event time; then it goes to the flow's machine, in order of
event time and number. So any split of an input into files and micro-batches gives the same result, as long as no row is later than
the delay. What a machine gives has an event time too, by which the next operator orders it: operators can be chained in one query.

`replay` is the batch twin: the same machine over a table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from flowlab.operators.hmm import LOWEST, Columns
from flowlab.sources.storage import materialise, new_table

#: Event times that no flow reaches, in microseconds: any at all, and one that pandas' timestamps can hold (in 2248).
NEVER, FAR = 1 << 62, 8_800_000_000_000_000


class Machine:
    """What a flow's rows do, one at a time. `rows`: the input's columns beside flow_id and ts, the number that orders rows of one time
    first; `out`: the output's; `state`: those of the state. step gives rows out, (microseconds, values...), and the new state (None: forget
    the flow); a flow that is silent for `idle` seconds ends, with the rows that end gives."""

    rows = out = state = ""
    idle: float | None = None

    def step(self, state, at: int, row: tuple) -> tuple[list, tuple | None]:
        raise NotImplementedError

    def last(self, state) -> int:
        """When the flow was last heard, for its idle time."""
        return state[-1]

    def end(self, state, at: int) -> list:
        return []

    def expiry(self, state) -> int:
        return NEVER if state is None or self.idle is None else self.last(state) + round(self.idle * 1e6)

    def advance(self, state, rows: list[tuple], until: int) -> tuple[list, tuple | None]:
        """Take ordered rows (microseconds, values...), all up to `until`, and end the flow where it is silent for too long."""
        out: list = []
        for at, *row in rows:
            if self.expiry(state) < at:
                out += self.end(state, self.expiry(state))
                state = None
            more, state = self.step(state, at, tuple(row))
            out += more
        if self.expiry(state) <= until:
            out += self.end(state, self.expiry(state))
            state = None
        return out, state


def advance(machine: Machine, state, rows: list[tuple], until: int) -> tuple[list, tuple | None]:
    return machine.advance(state, rows, until)


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Chained(Machine):
    """Machines of which each takes what the one before gives, as one machine: the rows that one gives up to a time are all there when
    its own rows up to then are, so the next takes them at once. A flow is then sent and kept once, not once for each machine.
    `links`: what makes the next machine's row (microseconds, values...) of one given. A state is those of all, each with whether it is there."""

    def __init__(self, machines: list[Machine], links: list):
        self.machines, self.links = machines, [None, *links]
        self.rows, self.out = machines[0].rows, machines[-1].out
        states = [[f"on{i} boolean", *(f"s{i}_{c}" for c in m.state.split(", "))] for i, m in enumerate(machines)]
        self.sizes = [len(x) for x in states]
        self.state = ", ".join(c for x in states for c in x)

    def _parts(self, state) -> list:
        out, at = [], 0
        for size in self.sizes:
            own = None if state is None else state[at : at + size]
            out.append(tuple(own[1:]) if own and own[0] else None)
            at += size
        return out

    def expiry(self, state) -> int:
        return min(m.expiry(part) for m, part in zip(self.machines, self._parts(state)))

    def advance(self, state, rows, until):
        after: list = []
        for machine, link, part, size in zip(self.machines, self.links, self._parts(state), self.sizes):
            if link:
                rows = sorted((link(r) for r in rows), key=lambda r: r[:2])
            rows, part = machine.advance(part, rows, until)
            after += [False, *[None] * (size - 1)] if part is None else [True, *part]
        return rows, tuple(after) if any(after[i] for i in np.cumsum([0, *self.sizes[:-1]])) else None


#: How a column's values are made Python's own: pandas makes floats of numbers that stand beside nulls.
OWN = {"long": int, "int": int, "double": float, "boolean": bool, "string": str}


def rows_of(frame: pd.DataFrame, schema: str) -> list[tuple]:
    """(microseconds, values...) of a frame with `at` and the columns of schema."""
    columns = [frame["at"].tolist()]
    for name, kind in (c.split() for c in schema.split(", ")):
        columns.append([None if missing else OWN[kind](v) for v, missing in zip(frame[name].tolist(), frame[name].isna().tolist())])
    return list(zip(*columns))


def frame_of(keys: list, rows: list, schema: str) -> pd.DataFrame:
    """Rows (microseconds, values...) of flows, the key of each beside it, as a frame (ts, flow_id, columns of schema)."""
    columns = list(zip(*rows)) if rows else [()] * (1 + len(names_of(schema)))
    data = {"ts": pd.to_datetime(pd.Series(columns[0], dtype="int64"), unit="us"), "flow_id": pd.Series(keys, dtype=object)}
    data |= {name: pd.Series(values, dtype=object) for name, values in zip(names_of(schema), columns[1:])}
    return pd.DataFrame(data)


#: Flows are dealt to this many buckets, which are the keys of the state: a call of the state store then serves many flows. It is fixed
#: for the life of a stream.
BUCKETS = 1024
ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


class Packed:
    """Rows of a bucket's state as one binary value in Arrow's format, columns of `schema`."""

    def __init__(self, schema: str):
        self.schema = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def bytes_of(self, rows: list[tuple]) -> bytes:
        columns = zip(*rows) if rows else [()] * len(self.schema)
        table = pa.table([pa.array(values, f.type) for values, f in zip(columns, self.schema)], schema=self.schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def rows_of(self, value: bytes) -> list[tuple]:
        return list(zip(*[c.to_pylist() for c in pa.ipc.open_stream(value).read_all().columns]))


class InOrder(StatefulProcessor):
    """The reorder buffer before a machine, and the timer that releases it and ends silent flows. The key is a bucket of flows: its
    rows wait together, and it has one timer, for the first of them and the first flow to end. So a call of the state store, a trip
    from Python to the executor and back, is made for a bucket and not for a flow; each flow's rows and state stay its own."""

    def __init__(self, machine: Machine, kind: str):
        self.machine, self.kind = machine, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.rows, self.states = Packed(f"flow {self.kind}, at long, {self.machine.rows}"), Packed(f"flow {self.kind}, {self.machine.state}")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "states binary")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int, now: int | None) -> None:
        """Set the timer to `at` (milliseconds) if it is earlier than that of now."""
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        number, new = names_of(self.machine.rows)[0], []
        for frame in rows:
            frame = frame[frame[number].notna()]  # a row without a number only moves the watermark
            new += [(flow, *row) for flow, row in zip(frame["flow_id"].tolist(), rows_of(frame, self.machine.rows))]
        if new:
            self.waiting.appendValue((self.rows.bytes_of(new),))
            self._wake(-(-min(r[1] for r in new) // 1000), self.due.get()[0] if self.due.exists() else None)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for part in self.waiting.get() for r in self.rows.rows_of(part[0])] if self.waiting.exists() else []
        held = {flow: state for flow, *state in self.states.rows_of(self.held.get()[0])} if self.held.exists() else {}
        ready: dict = {}
        for flow, *row in sorted((r for r in rows if r[1] <= until), key=lambda r: r[1:3]):
            ready.setdefault(flow, []).append(tuple(row))
        out, first = [], None
        for flow in ready.keys() | {f for f, state in held.items() if self.machine.expiry(tuple(state)) <= until}:
            before = tuple(held[flow]) if flow in held else None
            found, state = advance(self.machine, before, ready.get(flow, []), until)
            out += [(flow, *r) for r in found]
            if state is None:
                held.pop(flow, None)
            else:
                held[flow] = state
        later = [r for r in rows if r[1] > until]
        if ready:
            self.waiting.put([(self.rows.bytes_of(later),)]) if later else self.waiting.clear()
        if held:
            self.held.update((self.states.bytes_of([(flow, *state) for flow, state in held.items()]),))
        else:
            self.held.clear()
        ends = [r[1] for r in later] + [x for x in (self.machine.expiry(tuple(state)) for state in held.values()) if x < NEVER]
        self.due.clear()
        if ends:
            self._wake(-(-min(ends) // 1000), None)
        if out:
            yield frame_of([r[0] for r in out], [r[1:] for r in out], self.machine.out)

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, machine: Machine) -> DataFrame:
    """(ts, flow_id, machine.out) of a stream with a watermark on ts and the columns flow_id (a number or text) and machine.rows. Rows without a
    flow_id or a number only move the watermark."""
    names, kind = names_of(machine.rows), dict(stream.dtypes)["flow_id"]
    # a null key would make floats of the keys beside it: such rows go, without their number, to any flow
    number = F.when(F.col("flow_id").isNotNull(), F.col(names[0])).alias(names[0])
    key = F.coalesce("flow_id", F.lit("-1").cast(kind)).alias("flow_id")
    rows = stream.select("ts", key, F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"), number, *names[1:])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("flow_id"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(InOrder(machine, kind), f"ts timestamp, flow_id {kind}, {machine.out}", "append", "eventTime", eventTimeColumnName="ts")


def replay(rows: DataFrame, machine: Machine) -> DataFrame:
    """The batch twin of `ordered`, over a table: all flows have ended."""
    names, kind = names_of(machine.rows), dict(rows.dtypes)["flow_id"]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        rows = rows_of(frame.sort_values(["at", names[0]]), machine.rows)
        out = advance(machine, None, rows, NEVER - 1)[0]
        return frame_of([frame["flow_id"].iat[0]] * len(out), out, machine.out)

    own = rows.where(F.col("flow_id").isNotNull() & F.col(names[0]).isNotNull()).select("flow_id", F.unix_micros("ts").alias("at"), *names)
    return own.groupBy("flow_id").applyInPandas(work, f"ts timestamp, flow_id {kind}, {machine.out}")


#: State of several columns and timers, which the default store has not.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def arriving(rows: DataFrame, part, parts: int) -> DataFrame:
    """rows (ts, ...) as a stream of files: those of part 0 come first, each part in a micro-batch of its own.

    A part is one file for each shuffle partition. So that none is empty, each file has a row with the part's newest event time
    and nothing else, which moves the watermark no further than the part does. rows are made once, and their parts read from that table."""
    spark, path = rows.sparkSession, new_table(rows.sparkSession, "arriving")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = materialise(rows.withColumn("__part", part), "parts")
    for i in range(parts):
        own = made.where(F.col("__part") == i).drop("__part")
        marks = own.agg(F.max("ts").alias("ts")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(files - 1))))
        dealt = own.withColumn("slot", F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int")).unionByName(marks, allowMissingColumns=True)
        dealt.repartition(files, "slot").write.partitionBy("slot").parquet(f"{path}/part{i:04d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part*/slot*")


@dataclass(frozen=True)
class Ran:
    rows: DataFrame
    late: int  # rows that stateful operators dropped


def run_closed(stream: DataFrame, delay: str, make) -> Ran:
    """What make(stream with a watermark of `delay` on ts) gives over all that the stream has now, to its end.

    When the stream's data is through, a row of a far event time and nothing else moves the watermark past all of it, so what
    waits comes out; both runs go by one checkpoint. The sink is exactly once."""
    spark = stream.sparkSession
    path = new_table(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}-beats/none")
    beats = spark.readStream.schema(stream.schema).parquet(f"{path}-beats/*")
    out = make(stream.unionByName(beats).withWatermark("ts", delay))
    late = 0
    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        for last in (False, True):
            if last:
                beat = spark.range(1).select(F.timestamp_micros(F.lit(FAR)).alias("ts"))
                beat.select(*[(F.col(f.name) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]).write.parquet(f"{path}-beats/last")
            query = out.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).format("parquet").option("path", path).start()
            query.awaitTermination()
            late += sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return Ran(spark.read.schema(out.schema).parquet(path), late)


class Admit(Machine):
    """Packets of open flows: a ClientHello opens a flow, it ends after max_packets or when no packet came for `idle` seconds;
    packets without payload are passed over. `enter` is the time of the packet that opened it, in microseconds. `more`: columns handed on."""

    def __init__(self, max_packets: int, idle: float = 5.0, more: str = ""):
        self.max_packets, self.idle = max_packets, idle
        self.rows = "frame_number long, payload_len int, handshake_type int" + f", {more}" * bool(more)
        self.out = "frame_number long, place int, enter long" + f", {more}" * bool(more)
        self.state = "count int, enter long, last long"

    def step(self, state, at, row):
        number, size, kind, *more = row
        if not size or size <= 0 or state is None and kind != 1:
            return [], state
        count, enter, _ = state or (0, at, at)
        return [(at, number, count + 1, enter, *more)], (count + 1, enter, at) if count + 1 < self.max_packets else None


class DetectRecords(Machine):
    """Feature rows of in-sequence packets (direction, tcp_seq, tcp_len, content_type): out-of-sequence packets are dropped; a
    pause of over `idle` seconds ends the flow, with a row of direction 0 and number -1, `idle` after the last packet."""

    def __init__(self, idle: float = 1.0, more: str = ""):
        self.idle, self.more = idle, len(names_of(more)) if more else 0
        self.rows = "frame_number long, direction int, tcp_seq long, tcp_len int, content_type int" + f", {more}" * bool(more)
        self.out = "frame_number long, direction int, size int, content_type int" + f", {more}" * bool(more)
        self.state = "up long, down long, last long"

    def step(self, state, at, row):
        number, side, seq, size, kind, *more = row
        up, down, _ = state or (-1, -1, at)
        if (up if side < 0 else down) not in (-1, seq):
            return [], (up, down, at)
        return [(at, number, side, size, kind, *more)], (seq + size, down, at) if side < 0 else (up, seq + size, at)

    def end(self, state, at):
        return [(at, -1, 0, 0, 0, *[None] * self.more)]


class Scores(Machine):
    """What the online scores share: a score for each label after n symbols, or, if the flow ends before (a row without a symbol), then; with
    `every`, the scores of every prefix up to n. Later symbols are passed over until the flow ends or has been silent for `idle` seconds.
    `more`: columns handed on, with the values of the flow's first row."""

    kept = ""  # the columns of what a score has gathered

    def __init__(self, n: int, thresholds: dict[str, float], symbol: str, idle: float | None = None, every: bool = False, more: str = ""):
        self.labels = sorted(thresholds)
        self.n, self.thresholds, self.idle, self.every = n, thresholds, idle, every
        tail = f", {more}" * bool(more)
        self.rows = f"frame_number long, {symbol}{tail}"
        self.out = f"place int, model_label string, score double, member boolean{tail}"
        self.size = 1 + len(names_of(self.kept))
        self.state = f"count int, {self.kept}{tail}, last long"

    def begin(self) -> tuple:
        """What has been gathered before the first symbol."""
        raise NotImplementedError

    def move(self, gathered: tuple, symbol) -> tuple:
        raise NotImplementedError

    def scores(self, gathered: tuple) -> list[float]:
        raise NotImplementedError

    def _rows(self, at: int, count: int, gathered: tuple, more: tuple) -> list:
        return [(at, count, label, float(x), bool(x >= self.thresholds[label]), *more) for label, x in zip(self.labels, self.scores(gathered))]

    def step(self, state, at, row):
        _, symbol, *more = row
        count, gathered, more = (state[0], state[1 : self.size], state[self.size : -1]) if state else (0, self.begin(), tuple(more))
        if symbol is None:  # the flow's end
            return self._rows(at, count, gathered, more) if 0 < count < self.n and not self.every else [], None
        if count == self.n:
            return [], (*state[:-1], at)
        gathered, count = self.move(gathered, symbol), count + 1
        return self._rows(at, count, gathered, more) if self.every or count == self.n else [], (count, *gathered, *more, at)


class OnlineChain(Scores):
    """First-order chains of all labels, scored as symbols arrive. The edge table of a model set is small and travels with the code."""

    kept = "prev string, sums array<double>"

    def __init__(self, edges: dict[tuple[str, str, str], float], n: int, thresholds: dict[str, float], default: float = 1e-6, **settings):
        super().__init__(n, thresholds, "symbol string", **settings)
        self.table, self.miss = {k: math.log(p) for k, p in edges.items()}, math.log(default)

    def begin(self):
        return "START", [0.0] * len(self.labels)

    def move(self, gathered, symbol):
        prev, sums = gathered
        return symbol, [x + self.table.get((label, prev, symbol), self.miss) for label, x in zip(self.labels, sums)]

    def scores(self, gathered):
        return gathered[1]


class OnlineProfile(Scores):
    """Profiles of all labels. The state is the forward column of each: M, I and D of all its places, as logarithms. A symbol moves it
    once, so the work for a symbol is the same however long the flow is, and n may be any number."""

    kept = "columns array<double>"

    def __init__(self, models: dict, n: int, thresholds: dict[str, float] | None = None, **settings):
        super().__init__(n, thresholds or dict.fromkeys(models, -math.inf), "id int", **settings)
        self.columns = Columns([models[label] for label in self.labels])

    def begin(self):
        return (self.columns.start().tolist(),)

    def move(self, gathered, symbol):
        return (self.columns.move(np.array(gathered[0]), symbol).tolist(),)

    def scores(self, gathered):
        return np.maximum(self.columns.close(np.array(gathered[0])), LOWEST).tolist()


class Votes(Machine):
    """(votes) of the first num_models decisions of a flow. Then its state is a mark that passes over more decisions, until
    the flow has been silent for `idle` seconds."""

    rows, out, state = "frame_number long, decision int", "votes long", "count int, total long, last long"

    def __init__(self, num_models: int, idle: float | None = None):
        self.num_models, self.idle = num_models, idle

    def step(self, state, at, row):
        count, total, _ = state or (0, 0, at)
        if count == self.num_models:
            return [], (count, 0, at)
        count, total = count + 1, total + int(row[1])
        return ([(at, total)], (count, 0, at)) if count == self.num_models else ([], (count, total, at))


class BestMember(Machine):
    """(label, votes, enter, seconds) when the decisions of all num_models models of a flow are there: the label of the best score among
    those that took the flow as theirs (null: none did), how many did, when it entered, and how long the decision took. The flow is forgotten
    with it."""

    rows = "place int, model_label string, score double, member boolean, enter long"
    out = "label string, votes int, enter long, seconds double"
    state = "count int, label string, score double, votes int, last long"

    def __init__(self, num_models: int, idle: float | None = None):
        self.num_models, self.idle = num_models, idle

    def step(self, state, at, row):
        _, label, score, member, enter = row
        count, best, top, votes, _ = state or (0, None, -math.inf, 0, at)
        if member:
            best, top = (label, score) if best is None or (-score, label) < (-top, best) else (best, top)
        count, votes = count + 1, votes + bool(member)
        if count == self.num_models:
            return [(at, best, votes, enter, (at - enter) / 1e6)], None
        return [], (count, best, top, votes, at)


def classify_packets(stream: DataFrame, edges: dict, n: int, thresholds: dict[str, float], symbol, max_packets: int, idle: float = 5.0, pause: float = 1.0) -> DataFrame:
    """(ts, flow_id, label, votes, enter, seconds): packets in, labels out, by four machines that are chained in one operator: admission,
    record detection, chain scores of all labels, and their fan-in. `symbol` makes a symbol of the columns direction, size and content_type.

    stream: a watermark on ts; flow_id, frame_number, payload_len, handshake_type, direction, tcp_seq, tcp_len, content_type."""
    carried = "direction int, tcp_seq long, tcp_len int, content_type int, symbol string"
    machines = _machines(edges, n, thresholds, max_packets, idle, pause, carried, "enter long, symbol string")
    admitted, detected = ({c: i + 1 for i, c in enumerate(names_of(m.out))} for m in machines[:2])
    order = [admitted[c] for c in names_of(machines[1].rows)]
    side, word, enter = detected["direction"], detected["symbol"], detected["enter"]

    def symbols(row):  # records of one time come before the end row
        ended = not row[side] or row[word] is None
        return row[0], NEVER if ended else row[1], None if ended else row[word], row[enter]

    ints = stream.withColumns({"size": F.col("tcp_len").cast("int"), "direction": F.col("direction").cast("int"), "content_type": F.col("content_type").cast("int")})
    return ordered(ints.withColumn("symbol", symbol), Chained(machines, [lambda row: (row[0], *[row[i] for i in order]), symbols, lambda row: row]))


def _machines(edges, n, thresholds, max_packets, idle, pause, carried, handed) -> list[Machine]:
    """Admission, which hands on `carried`; record detection, which hands on `handed`; scores; fan-in."""
    scores = OnlineChain(edges, n, thresholds, idle=idle + pause, more="enter long")
    return [Admit(max_packets, idle, carried), DetectRecords(pause, handed), scores, BestMember(len(thresholds), idle=idle + pause)]


def classify_table(packets: DataFrame, edges: dict, n: int, thresholds: dict[str, float], symbol, max_packets: int, idle: float = 5.0, pause: float = 1.0) -> DataFrame:
    """The batch twin of classify_packets, one machine after the other."""
    # an empty payload is no record; the detector sees admitted packets only
    admit, detect, score, best = _machines(edges, n, thresholds, max_packets, idle, pause, "direction int, tcp_seq long, tcp_len int, content_type int", "enter long")
    detected = replay(replay(packets, admit), detect)
    symbols = detected.select("ts", "flow_id", "frame_number", F.when(F.col("direction") != 0, symbol).alias("symbol"), "enter")
    # records of one time come before the end row, whose number is -1
    symbols = symbols.withColumn("frame_number", F.when(F.col("symbol").isNull(), F.lit(NEVER)).otherwise(F.col("frame_number")))
    return replay(replay(symbols, score), best)
