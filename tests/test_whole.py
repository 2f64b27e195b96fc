"""Queries do the whole job: all labels, all flows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlab.operators.hmm import phmm_score
from flowlab.plans import models, streams
from flowlab.plans import views as V


def test_online_profiles_of_all_labels_are_fitted(spark, small):
    ids, _, params = streams._online_profiles(spark, small)
    params = params.persist()
    # the batch score of each prefix: its flow_id is (flow_id, place)
    first = ids.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(6)))).where("size(ids) >= place")
    first = first.select(F.concat_ws("|", "flow_id", "place").alias("flow_id"), F.expr("slice(ids, 1, place)").alias("ids"))
    want = {(*map(int, r.flow_id.split("|")), r.model_label): r.score for r in phmm_score(first, params).collect()}
    got = {(r.flow_id, r.place, r.model_label): r.score for r in streams.st5(spark, small).collect()}
    assert {k for _, _, k in got} == {r.label for r in ids.select("label").distinct().collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.fixture(scope="module")
def events(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    return con


def test_alignment_prior_counts_every_flow(spark, small, events):
    want = dict(events.execute(f"WITH {V.SEQS} SELECT label, count(*) FROM seqs GROUP BY label").fetchall())
    got = {r.label: r.n for r in models.m7(spark, small).where("place = 0 AND `from` = 'M'").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    assert got == want


def test_bin_count_is_judged_on_every_flow(spark, small, events):
    words = f"WITH {V.SYMBOLS}, w AS (SELECT flow_id, label, string_agg(bin, '' ORDER BY frame_number) AS word FROM symbols GROUP BY ALL)"
    want = events.execute(words + ", p AS (SELECT a.label = b.label AS inside, levenshtein(a.word, b.word) AS d FROM w a JOIN w b ON a.flow_id < b.flow_id) SELECT avg(d) FILTER (NOT inside) / avg(d) FILTER (inside) FROM p").fetchone()[0]
    got = {r.bins: r.separation for r in models.m14(spark, small).collect()}
    assert got.keys() == {2, 4, 8} and got[4] == pytest.approx(want)


def test_pairs_of_all_flows(spark, small, events):
    flows = events.execute(f"WITH {V.SEQS} SELECT count(*) FROM seqs").fetchone()[0]
    assert models.j9(spark, small).agg(F.sum("n")).first()[0] == flows * (flows - 1) // 2


def test_robustness_judges_every_setting(spark, small):
    rows = models.robustness(models._resized(spark, small, [100, 2**14]), V.records(spark, small)).collect()
    settings = {(m, c, hi, side) for m in ("mc", "phmm") for c in ("closed", "open") for hi, side in ((100, 0), (2**14, 0), (0, -1), (0, 1))}
    assert {(r.model, r.scenario, r.hi, r.direction) for r in rows} == settings
    assert {r.label for r in rows if r.scenario == "open"} == {*models.CLOSED, "unknown"} and {r.label for r in rows if r.scenario == "closed"} == {f"L{i}" for i in range(7)}
    # one setting by itself: chains that see no other label
    r = V.records(spark, small).where("direction <> 1").drop("handshake_type").withColumn("setting", F.lit("0:1"))
    alone = {(x.model, x.scenario, x.label): x.accuracy for x in models.robustness(r, V.records(spark, small)).collect() if x.model == "mc"}
    both = {(x.model, x.scenario, x.label): x.accuracy for x in rows if x.model == "mc" and (x.hi, x.direction) == (0, 1)}
    assert alone == pytest.approx(both) and len(models.LIMITS) == 18


def test_heads_of_resized_records_are_those_of_the_rows(spark, small, monkeypatch):
    """A row for each flow and setting says what all its records would, also where flows lie across batches and have empty records."""
    more = spark.createDataFrame([(-1, i, 1 if i % 50 else -1, 9000 * (i % 7), 23) for i in range(1, 400)] + [(-2, 1, 1, 0, 23), (-3, 1, -1, 0, 22)], "flow_id long, record_number int, direction int, length int, content_type int")
    records = V.records(spark, small).where("flow_id < 300").drop("handshake_type").unionByName(more)
    monkeypatch.setattr(V, "records", lambda *_: records.withColumn("handshake_type", F.lit(None).cast("int")))
    rows = [tuple(r) for r in models._resized(spark, small, [100, 2**14]).select("setting", "flow_id", "record_number", "direction", "content_type", "length").collect()]
    before, want = {}, {}
    for r in records.collect():
        before[r.flow_id] = before.get(r.flow_id, 0) + r.length + 5
    for setting, flow, _, side, kind, length in sorted(rows, key=lambda r: r[:3]):
        ratio, letters = want.get((setting, flow), (0, ""))
        code = ((kind - 20) * 4 + sum(length > m for m in (250, 750, 1250))) * 2 + (side > 0)
        want[setting, flow] = ratio + (length + 5) / before[flow], (letters + chr(48 + code))[: models.FIRST]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.setting, r.flow): (r.ratio, r.letters) for r in models._heads(spark, small, [100, 2**14]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and ("0:1", -2) not in got
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})


def test_profiles_take_whole_sequences(spark, small, monkeypatch):
    long = V.seqs(spark, small).withColumn("seq", F.concat("seq", "seq", "seq", "seq", "seq"))
    monkeypatch.setattr(V, "seqs", lambda *_: long)
    want = {r.flow_id: r.n for r in long.select("flow_id", F.size("seq").alias("n")).collect()}
    ids, _ = models._ids(spark, small)
    assert {r.flow_id: r.n for r in ids.select("flow_id", F.size("ids").alias("n")).collect()} == want and max(want.values()) > 8


@pytest.mark.parametrize("name", ["j10", "m1", "m7"])
def test_flows_are_made_from_events_once(spark, small, name):
    """What follows reads the written words, not the events again."""
    assert not [f for f in getattr(models, name)(spark, small).inputFiles() if "events.parquet" in f]
