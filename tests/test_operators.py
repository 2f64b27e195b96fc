"""Hand-computed cases, invariants and brute force of the flow operators."""

import itertools
import math
import random
import statistics
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlab.functions import symbols as S
from flowlab.functions import text as X
from flowlab.operators import aggregates as A
from flowlab.operators import chains as C
from flowlab.operators import evaluation as E
from flowlab.operators import hmm as H
from flowlab.operators import joins as J
from flowlab.operators import reassembly as R
from flowlab.operators import similarity as SI
from flowlab.operators import windows as W


def seqs(spark, data):
    return spark.createDataFrame([(i, label, 0, dset, list(s), s) for i, (label, dset, s) in enumerate(data)], "flow_id long, label string, day int, dset string, seq array<string>, word string")


def test_edges(spark):
    assert S.edges_equal(1500, 4) == [0, 500, 1000, 1500]
    assert S.edges_log(1500, 3) == pytest.approx([1, 38.729833, 1500])
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "v int")
    assert S.edges_frequency(df, "v", 2).first()[0] == [1, 3, 10]


@pytest.mark.parametrize("as_column", [False, True])
def test_nearest_edge_takes_the_first_on_a_tie(spark, as_column):
    edges = S.edges_equal(1500, 4)
    e = F.array(*[F.lit(x) for x in edges]) if as_column else edges
    df = spark.createDataFrame([(620,), (750,), (9999,)], "v int")
    assert [r[0] for r in df.select(S.nearest_edge(F.col("v"), e)).collect()] == [1, 1, 3]


def test_symbols(spark):
    row = spark.range(1).select(S.record_symbol(F.lit(1), F.lit(79), F.lit(22), F.lit(2)).alias("r"), S.symbol_hash(F.lit(1), F.lit(67), F.array(F.lit(3))).alias("h")).first()
    assert row.r == "22:2;79;S" and int(row.h) == 6381479052


def test_resample(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 10, 30])], "flow_id int, frame_number int, v int")
    assert W.resample(df, 5, "v").first().points == [0, 5, 10, 20, 30]


def test_summary(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 10)], "k string, v int")
    r = A.summary8(df, "k", "v", log2=True).first()
    assert (r.p05, r.median, r.p95, r["mean"]) == pytest.approx((1.15, 2.5, 8.95, 4)) and r.log_median == pytest.approx(1.292481, abs=1e-6)


def test_chain(spark):
    edges = C.fit_chain(seqs(spark, [("one", "train", "abc")] * 4))
    assert {(r["tail"], r["head"]): r.prob for r in edges.collect()} == {k: pytest.approx(1 - 3e-6) for k in (("START", "a"), ("a", "b"), ("b", "c"))}
    score = C.score_chain(seqs(spark, [("x", "test", "abe")]), edges).first().score
    assert score == pytest.approx(2 * math.log(1 - 3e-6) + math.log(1e-6))


def test_second_order_chain(spark):
    enter, trans, exit_ = C.fit_chain2(seqs(spark, [("l", "train", "xyz"), ("l", "train", "xyw")]))
    assert [r.prob for r in enter.collect()] == [1.0]
    assert sorted(r.prob for r in exit_.collect()) == [0.5, 0.5] == sorted(r.prob for r in trans.collect())


def test_as_of_join(spark):
    enter = spark.createDataFrame([(1, 10.0), (1, 10.2), (2, 10.0)], "k int, t double")
    exits = spark.createDataFrame([(1, 9.9), (1, 10.4), (1, 10.9), (2, 11.2)], "k int, t double")
    got = J.time_to_label(enter, exits, ["k"]).collect()
    assert [(r.k, round(r.delta, 6)) for r in got] == [(1, 0.4)]


def test_median_sequence(spark):
    got = SI.median_sequence(seqs(spark, [("l", "train", s) for s in ("abc", "a", "xxxabc", "abcxxx", "axxxc")]))
    assert got.first().word == "abc"


def test_metrics(spark):
    conf = spark.createDataFrame([(0, "A", "A", 8), (0, "A", "B", 2), (0, "B", "B", 5), (0, "B", "unknown", 5), (0, "X", "unknown", 9), (0, "X", "A", 1)], "day int, actual string, predicted string, n long")
    got = {r.label: (r.precision, r.recall, r.accuracy) for r in E.metrics_open(conf, ["A", "B"]).collect()}
    assert got == {"A": pytest.approx((8 / 9, 0.8, 27 / 30)), "B": pytest.approx((5 / 7, 0.5, 23 / 30)), "unknown": pytest.approx((9 / 14, 0.9, 24 / 30))}


def test_gap_ends_the_flow(spark):
    data = [(1, -1, 1, 0, 10), (1, -1, 2, 10, 5), (1, -1, 3, 10, 5), (1, 1, 4, 0, 7), (1, -1, 5, 20, 5), (1, 1, 6, 7, 7)]
    seg = spark.createDataFrame(data, "flow_id int, direction int, frame_number int, tcp_seq long, tcp_len int")
    assert sorted(r.frame_number for r in W.cut_at_gap(W.drop_retransmissions(seg)).collect()) == [1, 2, 4]


def test_longest_prefix(spark):
    pre = spark.createDataFrame([("10.0.0.0", 8, 1), ("10.1.0.0", 16, 2)], "prefix string, len int, asn int")
    ips = spark.createDataFrame([("10.1.2.3",), ("10.9.0.1",), ("11.0.0.1",)], "ip string")
    assert {r.ip: r.asn for r in J.ip_to_asn(ips, pre).collect()} == {"10.1.2.3": 2, "10.9.0.1": 1, "11.0.0.1": None}


def test_records_straddle_segments(spark):
    stream = bytes([22, 3, 3, 1, 44]) + bytes(300) + bytes([23, 3, 3, 0, 20]) + bytes(20)
    cuts = [(0, 200), (200, 325), (325, 330)]
    seg = spark.createDataFrame([(1, 1, i, a, b - a, bytearray(stream[a:b])) for i, (a, b) in enumerate(cuts)], "flow_id int, direction int, frame_number int, tcp_seq long, tcp_len int, payload binary")
    spans, inside = R.reassemble(seg)
    assert sorted((r.lo, r.hi, r.length) for r in spans.collect()) == [(0, 305, 300), (305, 330, 20)]
    assert sorted((r.record_number, r.frame_number) for r in inside.collect()) == [(0, 0), (0, 1), (1, 1), (1, 2)]


def test_resizing_keeps_bytes(spark):
    rows = [(f, i, 1 if i % 3 else -1, 23 if i % 4 else 22, 100 * i + f) for f in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, "flow_id long, record_number int, direction int, content_type int, length int").repartition(3)
    key = ("flow_id", "direction", "content_type")
    total = lambda d: {tuple(r)[:3]: r[3] for r in d.groupBy(*key).agg(F.sum("length")).collect()}
    out = R.resize_records(df, 50, 200, 3)
    assert total(out) == total(df) and out.where("content_type = 23").agg(F.max("length")).first()[0] <= 200


def test_flow_key_is_the_same_both_ways(spark):
    df = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1), ("a", 2, "b", 1)], "s string, p int, d string, q int")
    keys = [r[0] for r in df.select(X.flow_key(F.col("s"), F.col("p"), F.col("d"), F.col("q"))).collect()]
    assert keys[0] == keys[1] != keys[2]


def _all_paths(model, seq):
    """Probability of a sequence by enumeration of all state paths."""
    def go(i, kind, j):
        total = 0.0
        for to in range(3):
            p = model.t[i, kind, to]
            if to == H.M and i == model.length:
                total += p if j == len(seq) else 0.0
            elif to == H.M and j < len(seq):
                total += p * model.em[i, seq[j]] * go(i + 1, H.M, j + 1)
            elif to == H.I and j < len(seq):
                total += p * model.ei[i, seq[j]] * go(i, H.I, j + 1)
            elif to == H.D and i < model.length:
                total += p * go(i + 1, H.D, j)
        return total

    return go(0, H.M, 0)


@pytest.mark.parametrize("length", [1, 2])
def test_profile_forward_equals_enumeration(length):
    model = H.Profile.start(length, 2, 3)
    data = [list(s) for n in range(3) for s in itertools.product(range(2), repeat=n)]
    x, n = H.padded(data)
    got = np.exp(model.forward(x, n)[1])
    assert got == pytest.approx([_all_paths(model, s) for s in data])


def test_profile_training(spark):
    rng = np.random.default_rng(1)
    data = [("l", "val" if i % 5 == 0 else "train", [0, 1, 2, 3] if rng.random() < 0.9 else [0, 2, 3]) for i in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "flow_id long, label string, dset string, ids array<int>")
    first = H.phmm_fit(df, 4, 4, iterations=0).first()
    fitted = H.phmm_fit(df, 4, 4, iterations=3)
    row = fitted.first()
    assert row.nll < first.nll
    model = H.models_of(fitted)["l"]
    ok = H.Profile.allowed(4)
    assert model.t.sum(axis=2)[ok.any(axis=2)] == pytest.approx(1) and model.em.sum(axis=1) == pytest.approx(1) and model.ei.sum(axis=1) == pytest.approx(1)
    assert model.path([0, 1, 2, 3]) == ["M1", "M2", "M3", "M4"]
    assert all(r.score <= 0 for r in H.phmm_score(df, fitted).collect())


def test_alignment():
    assert H.edit_script("abc", "abc") == "mmm" and H.edit_script("xabc", "abc").count("i") == 1 and H.edit_script("ac", "abc").count("d") == 1


def test_knn(spark):
    train = seqs(spark, [("one", "train", "abc")] * 4 + [("two", "train", "efg")] * 4)
    test = seqs(spark, [("?", "test", s) for s in ("abc", "efg", "abe", "xyz")])
    got = {r.id: r.predicted for r in SI.knn(train, test, 3).collect()}
    assert got == {0: "one", 1: "two", 2: "one", 3: "one"}


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("k", float(v)) for v in rng.normal(5, 1, 300)], "k string, v double")
    ci = A.bootstrap_ci(df, "k", "v", b=200).first()
    assert ci.low < ci["mean"] < ci.high and ci.high - ci.low == pytest.approx(4 / math.sqrt(300), rel=0.4)
    assert A.bootstrap_test(df, "k", "v", 5.0, b=200).first().p > 0.01 > A.bootstrap_test(df, "k", "v", 6.0, b=200).first().p


def test_bootstrap_draws_are_repeatable(spark, monkeypatch):
    """As many draws as rows, the same however the rows are partitioned, and spread as drawing with replacement does."""
    monkeypatch.setattr(A, "VALUES", 10)
    df = spark.range(300).select(F.when(F.col("id") < 250, "a").otherwise("b").alias("k"), F.pmod(F.col("id") * 7, F.lit(90)).cast("double").alias("v"))
    df = df.union(spark.createDataFrame([("a", None), ("c", None)], df.schema))
    rows = [sorted(map(tuple, A.bootstrap_weights(x, "k", "v", 200, 5).collect())) for x in (df, df.repartition(5, "v"), df.coalesce(1))]
    assert rows[0] == rows[1] == rows[2]
    total = {}
    for k, sample, _, w in rows[0]:
        total[k, sample] = total.get((k, sample), 0) + w
    assert total == {(k, s): n for k, n in (("a", 250), ("b", 50)) for s in range(1, 201)}
    # a value that n of N rows have is drawn a binomial number of times
    own = [r[3] for r in rows[0] if r[:1] == ("a",) and r[2] == 0.0]
    n = sum(1 for i in range(250) if i * 7 % 90 == 0)
    own += [0] * (200 - len(own))
    assert np.mean(own) == pytest.approx(n, abs=4 * np.sqrt(n / 200)) and np.var(own) == pytest.approx(n, rel=0.5)
    assert rows[0] != sorted(map(tuple, A.bootstrap_weights(df, "k", "v", 200, 6).collect()))


def test_bootstrap_of_two_samples(spark):
    rng = np.random.default_rng(3)
    make = lambda mean, n: spark.createDataFrame([("k", float(x)) for x in rng.normal(mean, 2, n)], "k string, v double")
    first, same, other = make(5, 400), make(5, 300), make(6, 300)
    equal, apart = (A.bootstrap_two_samples(first, x, "k", "v", b=200).first() for x in (same, other))
    assert equal.p > 0.02 > apart.p and apart.difference == pytest.approx(-1, abs=0.5)
    assert A.bootstrap_two_samples(first, other, "k", "v", b=200, side="less").first().p < 0.02 < A.bootstrap_two_samples(first, other, "k", "v", b=200, side="greater").first().p


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_by_the_metric_index(spark, monkeypatch):
    """Words near and far, more neighbours wanted than there are, small parts of rings."""
    monkeypatch.setattr(SI, "RING", 3)
    monkeypatch.setattr(SI, "FIRST", 4)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    train = [(i, f"L{i % 3}", word(rng.choice((0, 1, 4, 9, 9, 9, 20)))) for i in range(150)] + [(200 + i, "M", "abcabcabc") for i in range(5)]
    test = [(1000 + i, word(rng.choice((0, 3, 9, 9, 14, 30)))) for i in range(40)] + [(1100, "abcabcabc"), (1101, "abcabcabd")]
    a, b = spark.createDataFrame(test, "flow_id long, word string"), spark.createDataFrame(train, "flow_id long, label string, word string")
    for k in (1, 4, 500):
        got = sorted(map(tuple, SI.nearest(a, b, k).collect()))
        want = []
        for i, w in test:
            near = sorted((plain_distance(w, o), j, label) for j, label, o in train)[:k]
            want += [(i, j, label, d, r) for r, (d, j, label) in enumerate(near, 1)]
        assert got == sorted(want)
    assert SI.nearest(a, b.limit(0), 3).count() == 0 == SI.nearest(a.limit(0), b, 3).count()


def test_records_of_long_streams_by_block_maps(spark, monkeypatch):
    """Streams over many blocks of 66 kB, maps composed three at a time, against a walk from header to header: records within a block and
    across two, streams that end in a header, in a record or with a byte that begins none."""
    monkeypatch.setattr(R, "BLOCK", 66_000)
    monkeypatch.setattr(R, "FAN", 3)
    rng = random.Random(8)
    body = np.random.default_rng(1).choice(np.array([0, 3, 20, 22, 23, 90], np.uint8), 70_000).tobytes()
    segments, want = [], []
    for flow in range(8):
        for side in (-1, 1):
            stream = b""
            for _ in range(rng.choice((0, 1, 30, 60, 90))):
                n = rng.choice((0, 1, 7, 500, 16_384, 30_000, 65_535))
                stream += bytes([rng.choice((20, 21, 22, 23, 24)), 3, 3, n >> 8, n & 255]) + body[: n - n % 3] + body[-(n % 3) :][: n % 3]
            stream += rng.choice((b"", b"\x17", b"\x17\x03\x03\x00", b"\x17\x03\x03\xff\x00ab", b"\x00\x01\x02\x03\x04\x05", b"\x09" + b"\x17" * 90))
            want += [(flow, side, i, *r) for i, r in enumerate(R.walk(stream))]
            at = 0
            while at < len(stream):
                n = rng.choice((1, 5, 1300, 40_000, 150_000))
                part = stream[at : at + n]
                segments.append((flow, side, at, at + len(part), bytearray(part)))
                at += len(part)
    rng.shuffle(segments)
    df = spark.createDataFrame(segments, "flow_id long, direction int, lo long, hi long, payload binary").repartition(4)
    assert sorted(map(tuple, R.record_spans(df).collect())) == sorted(want) and len(want) > 300
    assert max(s[3] for s in segments) > 20 * R.BLOCK and R.record_spans(df.limit(0)).count() == 0


def test_streams_that_end_about_the_edge_of_a_block(spark):
    """Records of streams that stop just before, at and behind the bytes a block sees of the next, beside short ones; where none has a
    second block, the rows need no further shuffle."""
    def stream(length):
        out = b""
        while len(out) < length:
            size = min(60_000, max(0, length - len(out) - 5))
            out += bytes([23, 3, 3, size >> 8, size & 255]) + bytes(size)
        return out[:length]

    streams = {1: stream(7), 2: stream(900) + bytes([23, 3, 3, 9, 9, 1]), 3: b"\0" * 50}
    short = dict(streams)
    streams |= {10 + k: stream(R.BLOCK + k) for k in (-1, 0, 2, 3, 4, 5, 9)} | {30: stream(2 * R.BLOCK + 2) + bytes([23, 3, 3, 200, 0, 1]), 31: stream(R.BLOCK + 2)[:-40] + bytes([22, 3, 3, 200, 0])}
    schema = "flow_id long, direction int, lo long, hi long, payload binary"

    def spans(those):
        rows = [(f, 1, lo, min(lo + 1400, len(x)), x[lo : lo + 1400]) for f, x in those.items() for lo in range(0, len(x), 1400)]
        return R.record_spans(spark.createDataFrame(rows, schema))

    want = {f: [(f, 1, n, *r) for n, r in enumerate(R.walk(x))] for f, x in streams.items()}
    assert sorted(map(tuple, spans(streams).collect())) == sorted(sum(want.values(), []))
    found = spans(short)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(sum((want[f] for f in short), []))


def test_a_stopped_training_goes_on(spark, tmp_path, monkeypatch):
    """A training in two runs by a folder gives what one run gives; sums by a tree give the same for any number of tasks; it ends by tolerance."""
    monkeypatch.setattr(H, "FAN", 2)
    rng = random.Random(4)
    rows = [(i, "xy"[i % 2], "val" if i % 5 == 0 else "train", [rng.choice((0, 0, 1) if i % 2 else (1, 2)) for _ in range(rng.randint(2, 7))]) for i in range(60)]
    df = spark.createDataFrame(rows, "flow_id long, label string, dset string, ids array<int>")
    for fit, cut in ((lambda d, **k: H.phmm_fit(d, 3, 3, tolerance=0, **k), {"iterations": 2}), (lambda d, **k: H.hmm_fit(d, 2, 3, tolerance=0, **k), {"iterations": 2})):
        whole = {r.label: r.params for r in fit(df.repartition(7), iterations=4).collect()}
        where = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        fit(df.coalesce(1), path=where, **cut)
        after = {r.label: r.params for r in fit(df.repartition(3), iterations=4, path=where).collect()}
        assert whole.keys() == after.keys() == {"x", "y"} and all(whole[k] == pytest.approx(after[k], rel=1e-6, abs=1e-9) for k in whole)
    assert H.Progress(spark, where).load()[0] == 4
    H.phmm_fit(df, 3, 3, iterations=50, tolerance=0.5, path=f"{tmp_path}/soon")
    assert H.Progress(spark, f"{tmp_path}/soon").load()[0] == 2


@pytest.mark.parametrize("lengths", [(0, 1, 5, 8), (9, 16, 3), (20, 32, 64), (0, 65, 128, 130)])
def test_distances_of_blocks_of_words(lengths):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
    a, b = [word("ab一") for _ in range(12)], [word("ab一z") for _ in range(9)]
    own = SI.Coded(a)
    got = SI.Patterns(own, slice(None)).distances(SI.Coded(b, own.symbols), slice(None))
    assert got.tolist() == [[plain_distance(x, y) for x in a] for y in b]


def test_words_of_a_block_share_their_prefixes(monkeypatch):
    words = ["abcd", "abce", "abc", "abd", "", "b"]
    trie = SI.Coded(words).trie(slice(None))
    assert [len(symbols) for _, symbols, _, _ in trie] == [2, 1, 2, 2]  # a b, ab, abc abd, abcd abce: 7 of 15 letters
    rng = random.Random(6)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), rng.choice("xyz"), rng.randint(1, 3)) for _ in range(60)]
    frame = pd.DataFrame(rows, columns=["word", "label", "n"]).drop_duplicates(["word", "label"]).assign(group="", stripe=0, i=0, j=0)
    found = []
    for most in (3, 0):  # pairs counted singly, and as products of tables
        monkeypatch.setattr(SI, "MOST_SPREAD", most)
        found.append({(r.label_a, r.label_b, r.dist): r.n for r in SI._tally(frame).groupby(["label_a", "label_b", "dist"], as_index=False).sum().itertuples()})
    want: dict = {}
    flows = [r for r in frame.itertuples() for _ in range(r.n)]
    for k, x in enumerate(flows):
        for y in flows[:k]:
            key = (*sorted((x.label, y.label)), plain_distance(x.word, y.word))
            want[key] = want.get(key, 0) + 1
    assert found[0] == found[1] == want


def test_pairs_and_medians_by_stripes(spark, monkeypatch):
    """Stripes of few words, words of several labels, repeated rows: against all pairs; a word comes as often as there are stripes."""
    monkeypatch.setattr(SI, "STRIPE", (6, 9))
    monkeypatch.setattr(SI, "MOST_STRIPES", 3)
    monkeypatch.setattr(SI, "PATTERNS", 4)
    rng = random.Random(4)
    rows = [(i, rng.choice("LMN"), "".join(rng.choice("abc") for _ in range(rng.choice((0, 2, 3, 5, 17))))) for i in range(70)]
    df = spark.createDataFrame(rows, "flow_id long, label string, word string")
    want = Counter()
    for i, la, a in rows:
        for j, lb, b in rows:
            if i < j:
                want[min(la, lb), max(la, lb), plain_distance(a, b)] += 1
    assert {(r.label_a, r.label_b, r.dist): r.n for r in SI.label_pairs(df).collect()} == want
    best = {}
    for label in "LMN":
        own = [w for _, x, w in rows if x == label]
        best[label] = min((statistics.median(plain_distance(a, b) for b in own), a) for a in own)
    assert {r.label: (r.median, r.word) for r in SI.median_sequence(df).collect()} == best
    words = SI.materialise(df.groupBy(F.lit("").alias("group"), "label", "word").agg(F.count("*").alias("n")), "words")
    stripes = -(-words.count() // 9)
    assert SI._cells(words).count() == words.count() * stripes
    grouped = SI.label_pairs(df.withColumn("g", F.col("flow_id") % 2), "g").agg(F.sum("n")).first()[0]
    assert grouped == 2 * (35 * 34 // 2)


def test_models_take_equal_sequences_once():
    rng = np.random.default_rng(3)
    seqs, lengths = H.padded([list(rng.integers(-1, 5, rng.integers(1, 12))) for _ in range(40)])
    counts = rng.integers(1, 5, 40)
    profile, dense = H.Profile.start(4, 5, 1), H.Dense.start(3, 5, 1)
    sums, logp = profile.expectations(seqs, lengths, counts)
    each = [profile._expectations(seqs[[k]], lengths[[k]]) for k in range(40)]
    assert np.allclose(sums, sum(n * x for n, (x, _) in zip(counts, each))) and np.allclose(logp, [p[0] for _, p in each])
    assert np.allclose(profile.likelihoods(seqs, lengths), profile.forward(seqs, lengths)[1])
    sums, logp = dense.sums(seqs, lengths, counts)
    each = [dense.expectations(list(x[:n])) for x, n in zip(seqs, lengths)]
    assert np.allclose(sums, sum(n * x for n, (x, _) in zip(counts, each))) and np.allclose(logp, [p for _, p in each])
    assert np.allclose(dense.likelihoods(seqs, lengths), logp)


def test_sizes_drawn_at_once_are_those_drawn_singly(spark):
    rows = [(k, n + 1, 1 if n < 3 else -1, 23 if n != 4 else 22, 700 + 90 * n) for k in range(3) for n in range(6)]
    df = spark.createDataFrame(rows, "flow_id long, record_number int, direction int, content_type int, length int")
    got = [tuple(r) for r in R.resize_records(df, 50, [90, 400], 3).orderBy("hi", "flow_id", "record_number").collect()]
    want = []
    for hi in (90, 400):
        for k in range(3):
            rng, out = np.random.default_rng([3, k]), []
            for side, content, total in ((1, 23, 700 + 790 + 880), (-1, 23, 970), (-1, 22, 1060), (-1, 23, 1150)):
                while total:
                    out.append((side, content, total if content != 23 else min(total, int(rng.integers(50, hi + 1)))))
                    total -= out[-1][2]
            want += [(k, n + 1, *r, hi) for n, r in enumerate(out)]
    assert got == want


def test_short_vocabularies_are_looked_up_in_the_row(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["b", "a", "z"]), (2, []), (3, ["a"])], "flow_id long, seq array<string>")
    vocab = SI.vocabulary(spark.createDataFrame([(["a", "b"],)], "seq array<string>"))
    rows = lambda: sorted((r.flow_id, tuple(r.ids), r.word) for r in SI.encode(df, vocab).collect())
    short = rows()
    monkeypatch.setattr(SI, "SHORT", 0)
    assert short == rows() and [r[1] for r in short] == [(1, 0, -1), (0,)]


def test_values_are_resampled_in_one_pass(spark):
    df = spark.createDataFrame([(k, n, float(n * k), float(n - k)) for k in (1, 2) for n in range(5 * k)], "flow_id long, frame_number int, total double, signed double")
    both = {r.flow_id: (r.total, r.signed) for r in W.resample(df, 4, ["total", "signed"]).collect()}
    alone = [{r.flow_id: r.points for r in W.resample(df, 4, v).collect()} for v in ("total", "signed")]
    assert both == {k: tuple(a[k] for a in alone) for k in (1, 2)}


def test_distances_of_one_and_several_integers(monkeypatch):
    """Words as wide as their integers and shorter ones, empty ones, letters that the patterns have not, arrays used again."""
    rng = random.Random(6)
    for lengths in ((0, 1, 7, 8), (0, 8, 9, 16), (3, 31, 32), (0, 5, 63, 64), (2, 64, 65, 130)):
        left = ["".join(rng.choice("abc") for _ in range(rng.choice(lengths))) for _ in range(9)]
        right = sorted("".join(rng.choice("abcz") for _ in range(rng.choice((0, *lengths, 70)))) for _ in range(12))
        a = SI.Coded(left)
        b = SI.Coded(right, a.symbols)
        want = [[plain_distance(x, y) for x in left] for y in right]
        assert SI.Patterns(a, slice(0, 9)).distances(b, slice(0, 12)).tolist() == want


def test_stripes_are_ranges_and_as_many_as_the_words_need(spark, monkeypatch):
    """Words under several labels call for no more stripes; a stripe's words are neighbours, so they share prefixes."""
    monkeypatch.setattr(SI, "STRIPE", (16, 64))
    words = sorted({f"{k * 7919 % 4096:012b}" for k in range(64)})
    rows = spark.createDataFrame([("", label, w, 1) for w in words for label in "LMNOP"], "group string, label string, word string, n long")
    cells = SI._cells(rows, "count(distinct word)").select("stripe", "word").distinct().collect()
    ranges = {}
    for r in cells:
        ranges.setdefault(r.stripe, []).append(r.word)
    assert 1 < len(ranges) <= 4 and sum(map(len, ranges.values())) == 64
    ends = sorted((min(w), max(w)) for w in ranges.values())
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_searched_words_are_dealt_by_ranges(spark, monkeypatch):
    """Words of a stripe are neighbours, so they share prefixes, and none is lost."""
    monkeypatch.setattr(SI, "STRIPE", (8, 64))
    tables, write = {}, SI.materialise
    monkeypatch.setattr(SI, "materialise", lambda df, name: tables.setdefault(name, write(df, name)))
    words = [f"{k * 7919 % 4096:012b}" for k in range(40)]
    df = spark.createDataFrame([(k, "L", w) for k, w in enumerate(words)], "flow_id long, label string, word string")
    assert sorted((r.id, r.dist) for r in SI.nearest(df, df, 1).collect()) == [(k, 0) for k in range(40)]
    ranges = {}
    for r in tables["ranged"].collect():
        ranges.setdefault(r.s, []).append(r.word)
    ends = sorted((min(w), max(w)) for w in ranges.values())
    assert len(ends) > 1 and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
