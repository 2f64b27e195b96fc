"""Queries of the streaming operators: run over all events, compared with SQL of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions.symbols import edges_equal, record_symbol, symbol_hash
from flowlab.operators import chains as C
from flowlab.operators import hmm as H
from flowlab.operators.similarity import encode, vocabulary
from flowlab.operators.windows import running
from flowlab.plans import views as V
from flowlab.plans.base import query
from flowlab.plans.models import OPEN
from flowlab.streaming import ordered as O
from flowlab.streaming import stateful as ST


#: Seconds of silence after which a flow's scores are forgotten: flows are three days long.
FORGET = 3 * 86400.0


def packets(spark, d, e=None):
    """The events stream as packets, without a watermark; the event's number takes the place of a frame number."""
    e = ST.read_events(spark, d) if e is None else e
    kind = F.col("event_type")
    return e.select(
        "ts", (F.col("user_id") * 100 + F.expr("(day(ts) - 1) div 3")).alias("flow_id"), "user_id", F.col("event_id").alias("frame_number"), (F.unix_micros("ts") / 1e6).alias("time_epoch"), F.when(kind.isin("click", "purchase", "signup"), -1).otherwise(1).alias("direction"),
        F.floor(F.col("value") * 3).cast("int").alias("tcp_length"), F.when(kind == "signup", 22).when(kind == "purchase", 20).when(kind == "error", 21).otherwise(23).alias("content_type"), F.when(kind == "signup", 1).alias("handshake_type"),
    )


#: Packets of the events in order, as SQL; n numbers those of a flow.
PACKETS_SQL = """f AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY t, frame_number) AS n FROM (SELECT user_id * 100 + (day(ts) - 1) // 3 AS flow_id, event_id AS frame_number, epoch_us(ts) AS t,
  CAST(floor(value * 3) AS INT) AS size, event_type = 'signup' AS hello, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN -1 ELSE 1 END AS direction, CASE event_type WHEN 'signup' THEN 22 WHEN 'purchase' THEN 20 WHEN 'error' THEN 21 ELSE 23 END AS content_type FROM events){where})"""


@query("st1_admit", f"""WITH RECURSIVE {PACKETS_SQL.format(where=" WHERE size > 0")},
s AS (SELECT DISTINCT flow_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS frame_number, 0 AS place, CAST(0 AS BIGINT) AS enter, CAST(0 AS BIGINT) AS last FROM f
  UNION ALL SELECT flow_id, n, frame_number, CASE WHEN open THEN place + 1 WHEN hello THEN 1 ELSE 0 END, CASE WHEN open THEN enter ELSE t END, t
  FROM (SELECT f.flow_id, f.n, f.frame_number, s.place, s.enter, f.t, f.hello, s.place BETWEEN 1 AND 3 AND f.t - s.last <= 86400000000 AS open FROM s JOIN f ON f.flow_id = s.flow_id AND f.n = s.n + 1))
SELECT flow_id, frame_number, CAST(place AS INT) AS place, enter FROM s WHERE place > 0""")
def st1(spark, d):
    rows = packets(spark, d).select("ts", "flow_id", "frame_number", F.col("tcp_length").alias("payload_len"), F.coalesce("handshake_type", F.lit(0)).alias("handshake_type"))
    return O.run_closed(rows, "1 hour", lambda s: O.ordered(s, O.Admit(4, 86400.0))).rows.drop("ts")


@query("st2_detect_records", f"""WITH RECURSIVE {PACKETS_SQL.format(where="")},
s AS (SELECT DISTINCT flow_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS frame_number, CAST(0 AS BIGINT) AS t, -1 AS up, -1 AS down, 0 AS direction, 0 AS size, 0 AS content_type, false AS taken FROM f
  UNION ALL SELECT flow_id, n, frame_number, t, CASE WHEN taken AND direction < 0 THEN size ELSE up END, CASE WHEN taken AND direction > 0 THEN size ELSE down END, direction, size, content_type, taken
  FROM (SELECT *, CASE WHEN direction < 0 THEN up ELSE down END IN (-1, 0) AS taken FROM (SELECT f.flow_id, f.n, f.frame_number, f.t, CASE WHEN f.size % 5 = 0 THEN f.size ELSE 0 END AS size, f.direction, f.content_type,
    CASE WHEN f.t - s.t > 86400000000 THEN -1 ELSE s.up END AS up, CASE WHEN f.t - s.t > 86400000000 THEN -1 ELSE s.down END AS down FROM s JOIN f ON f.flow_id = s.flow_id AND f.n = s.n + 1)))
SELECT flow_id, frame_number, CAST(direction AS INT) AS direction, CAST(size AS INT) AS size, CAST(content_type AS INT) AS content_type, t AS "at" FROM s WHERE taken
UNION ALL SELECT flow_id, -1, 0, 0, 0, t + 86400000000 FROM (SELECT flow_id, t, lead(t) OVER (PARTITION BY flow_id ORDER BY n) AS next FROM f) WHERE next IS NULL OR next - t > 86400000000""")
def st2(spark, d):
    """Every packet is said to begin at 0, so after one with content (a multiple of 5) its direction is out of sequence until the flow pauses."""
    rows = packets(spark, d).select("ts", "flow_id", "frame_number", "direction", (F.col("frame_number") * 0).alias("tcp_seq"), F.when(F.col("tcp_length") % 5 == 0, F.col("tcp_length")).otherwise(0).alias("tcp_len"), "content_type")
    found = O.run_closed(rows, "1 hour", lambda s: O.ordered(s, O.DetectRecords(86400.0))).rows
    return found.withColumn("at", F.unix_micros("ts")).drop("ts")


def frames(spark, d):
    return packets(spark, d, ST.with_lateness(ST.read_events(spark, d), "1 hour"))


@query("st3_symbols", f"WITH {V.FRAMES}, e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END AS a, CAST(floor(value * 3) AS BIGINT) AS s, CASE event_type WHEN 'signup' THEN 22 WHEN 'purchase' THEN 20 WHEN 'error' THEN 21 ELSE 23 END AS t FROM events) SELECT event_id AS frame_number, CAST(((((5381::HUGEINT * 33 + a) * 33 + s // 256) * 33 + s % 256) * 33 + t) % 18446744073709551616 AS VARCHAR) AS h FROM e")
def st3(spark, d):
    h = symbol_hash(F.when(F.col("direction") < 0, 1).otherwise(0), F.col("tcp_length"), F.array("content_type"))
    return ST.run_available(frames(spark, d).select("frame_number", h.cast("string").alias("h")))


def _symbols(spark, d):
    return packets(spark, d).withColumn("symbol", record_symbol(F.col("direction"), F.col("tcp_length"), F.col("content_type"), F.col("handshake_type"), edges_equal(*V.BIN_EDGES)))


@query("st4_online_chain", OPEN.replace("FROM symbols WHERE true", "FROM symbols WHERE frame_number <= 4 AND flow_id IN (SELECT flow_id FROM symbols WHERE frame_number = 4)") + " SELECT flow_id, model_label, round(score, 6) AS score, round(score, 6) >= -12 AS member FROM scores")
def st4(spark, d):
    """Chains fitted in batch, applied to the stream after 4 symbols. The edge table is as large as the symbols' alphabet squared."""
    table, limits = _chains(spark, d)
    rows = _symbols(spark, d).select("ts", "flow_id", "frame_number", "symbol")
    found = O.run_closed(rows, "1 hour", lambda s: O.ordered(s, O.OnlineChain(table, 4, limits, idle=FORGET))).rows
    return found.select("flow_id", "model_label", F.round("score", 6).alias("score"), (F.round("score", 6) >= -12).alias("member"))


def _chains(spark, d):
    """(edges, thresholds) of all labels, fitted in batch on the training rows."""
    edges = C.fit_chain(V.seqs(spark, d).where("dset = 'train'")).collect()
    return {(r.label, r["tail"], r["head"]): r.prob for r in edges}, {r.label: -12.0 for r in edges}


def _online_profiles(spark, d):
    """(sequences with ids, profiles of all labels), fitted in batch on the training rows; symbols of whole sequences."""
    s = V.seqs(spark, d)
    vocab = vocabulary(s.where("dset = 'train'")).persist()
    codes = {r.symbol: r.id for r in vocab.collect()}
    ids = encode(s, vocab)
    return ids, codes, H.phmm_fit(ids, 4, len(codes), iterations=2)


@query("st5_online_phmm")
def st5(spark, d):
    """Profiles of all labels, fitted in batch, applied to the stream: the score of every prefix up to 6 symbols."""
    _, codes, params = _online_profiles(spark, d)
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    rows = _symbols(spark, d).select("ts", "flow_id", "frame_number", F.coalesce(F.try_element_at(known, "symbol"), F.lit(-1)).cast("int").alias("id"))
    machine = O.OnlineProfile(H.models_of(params), 6, idle=FORGET, every=True)
    return O.run_closed(rows, "1 hour", lambda s: O.ordered(s, machine)).rows.select("flow_id", "place", "model_label", "score")


@query("st6_votes", "SELECT user_id * 100 + (day(ts) - 1) // 3 AS flow_id, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id, (day(ts) - 1) // 3 ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5 GROUP BY flow_id HAVING count(*) = 5")
def st6(spark, d):
    rows = ST.read_events(spark, d).select("ts", (F.col("user_id") * 100 + F.expr("(day(ts) - 1) div 3")).alias("flow_id"), F.col("event_id").alias("frame_number"), (F.col("value") > 50).cast("int").alias("decision"))
    return O.run_closed(rows, "1 hour", lambda s: O.ordered(s, O.Votes(5, idle=FORGET))).rows.select("flow_id", "votes")


@query("st7_ttl", "SELECT a.user_id, a.ts AS enter, b.ts AS exit FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS")
def st7(spark, d):
    e = ST.read_events(spark, d)
    rows = ST.ttl_stream(e.where("event_type = 'click'"), ST.read_events(spark, d).where("event_type = 'purchase'"), "user_id", "6 hours")
    return ST.run_available(rows).select("user_id", F.col("enter").cast("timestamp_ntz").alias("enter"), F.col("exit").cast("timestamp_ntz").alias("exit"))


@query("st8_idle_sessions", "WITH x AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS, true) AS new FROM events), s AS (SELECT user_id, ts, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def st8(spark, d):
    rows = ST.idle_sessions(ST.with_lateness(ST.read_events(spark, d), "1 hour"), "6 hours", "user_id")
    return ST.run_available(rows, "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


#: Days by which an event arrives late, by its number; most come at once.
DELAY = "CASE WHEN event_id % 11 = 0 THEN event_id % 13 ELSE 0 END"


@query("st9_lateness", f"""WITH a AS (SELECT event_type, ts, (day(ts) - 1 + {DELAY}) // 6 AS part FROM events), seen AS (SELECT p.part, max(a.ts) AS newest FROM (SELECT DISTINCT part FROM a) p LEFT JOIN a ON a.part <= p.part - 2 GROUP BY p.part),
w AS (SELECT event_type, date_trunc('day', ts) AS start, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= newest - INTERVAL 36 HOURS, false) AS late FROM a JOIN seen USING (part))
SELECT event_type, start, count(*) AS n, false AS late FROM w WHERE NOT late GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*), true FROM w WHERE late""")
def st9(spark, d):
    """Counts by day of events that arrive in eight parts, some of them days after their time: an event whose day has been passed by the
    watermark (36 hours behind the newest event, up to the last part but one) is dropped. The last row has how many were."""
    e = V.table(spark, d, "events")
    stream = O.arriving(e, F.floor((F.dayofmonth("ts") - 1 + F.expr(DELAY)) / 6), 8)
    counts = O.run_closed(stream, "36 hours", lambda s: s.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))).rows.where("event_type is not null")
    rows = counts.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.lit(False).alias("late"))
    dropped = e.agg(F.count("*").alias("n")).crossJoin(counts.agg(F.sum("n").alias("counted"))).select((F.col("n") - F.col("counted")).alias("n"), F.lit(True).alias("late"))
    return rows.unionByName(dropped, allowMissingColumns=True)


def _arriving_packets(spark, d):
    """The events as packets with sequence numbers (every ninth again, as a retransmission a minute later), which arrive up to two days late."""
    f = V.frames(spark, d).select("flow_id", "direction", "content_type", "handshake_type", "frame_number", F.col("tcp_length").alias("tcp_len"), F.timestamp_micros((F.col("time_epoch") * 1e6).cast("long")).alias("ts"))
    f = running(f, ["flow_id", "direction"], F.to_date("ts"), ["ts", "frame_number"], {"tcp_seq": F.col("tcp_len")}).withColumn("tcp_seq", (F.col("tcp_seq") - F.col("tcp_len")).cast("long"))
    again = f.where("frame_number % 9 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE")).withColumn("frame_number", F.col("frame_number") + 1_000_000)
    f = f.unionByName(again).withColumn("payload_len", F.col("tcp_len")).withColumn("handshake_type", F.coalesce("handshake_type", F.lit(0)))
    f = f.withColumn("frame_number", F.col("frame_number").cast("long"))
    return f, F.floor((F.dayofmonth("ts") - 1 + F.pmod(F.xxhash64("flow_id", "frame_number"), F.lit(3))) / 5)


def online_symbol(size: str = "size"):
    """The symbol of a detected record; a handshake is a ClientHello in these tables."""
    return record_symbol(F.col("direction"), F.col(size), F.col("content_type"), F.when(F.col("content_type") == 22, 1), edges_equal(*V.BIN_EDGES))


@query("st10_online_classify")
def st10(spark, d):
    """Packets in, labels out: admission, record detection, symbols, chains of all labels and their fan-in in one operator, over packets
    that arrive in disorder in seven parts."""
    table, limits = _chains(spark, d)
    rows, part = _arriving_packets(spark, d)
    return O.run_closed(O.arriving(rows, part, 7), "3 days", lambda s: O.classify_packets(s, table, 4, limits, online_symbol(), 12, 86400.0, 43200.0)).rows.drop("ts")
