"""Toxicity: counts, ratios, fit and scores against a plain version; recall and AUC on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import toxicity as T


def brute_buckets(text):
    raw, out = [], set()
    for b in f" {text.lower()} ".encode():
        b = b if b >= 128 or chr(b).isalnum() else 32
        if b != 32 or not raw or raw[-1] != 32:
            raw.append(b)
    for n in T.NGRAMS:
        for i in range(len(raw) - n + 1):
            v = n
            for b in raw[i : i + n]:
                v = (v * 0x01000193 + b) % (1 << 32)
            out.add((v * 0x9E3779B1 % (1 << 32)) >> (32 - T.BITS))
    return out


def test_buckets():
    for text in ("", " ", "a", "Some Words, twice!! some words", "na\u00efve caf\u00e9 \u65e5\u672c 123", "x" * 50):
        assert set(T.ngram_buckets(text).tolist()) == brute_buckets(text)


def test_whole_operator(spark, small):
    """Every score is the logistic of the weights' sum; the weights are the log-count ratios times a stationary point of the loss."""
    big = small.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where(F.char_length("text") < 2500)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    label = {r.doc_id: int(r.toxic) for r in labels.collect() if r.toxic is not None and r.doc_id in texts}
    train = {d: y for d, y in label.items() if zlib.crc32(str(d).encode()) % 5}
    own = {d: brute_buckets(t) for d, t in texts.items()}
    n = [sum(y == k for y in train.values()) for k in (0, 1)]
    assert min(n) > 2
    ratio, seen = {}, [Counter(b for d, y in train.items() if y == v for b in own[d]) for v in (0, 1)]
    for b in seen[0] | seen[1]:
        k = [seen[0][b], seen[1][b]]
        r = math.log((k[1] + 1) / (n[1] + 2)) - math.log((k[0] + 1) / (n[0] + 2))
        if abs(r) >= T.CERTAIN * math.sqrt(1 / (k[1] + 1) + 1 / (k[0] + 1)):
            ratio[b] = r
    known = T.labelled_documents(docs, labels)
    weights, start = T.fit(known)
    assert set(np.flatnonzero(weights).tolist()) <= set(ratio) and ratio
    x = {b: weights[b] / r for b, r in ratio.items()}
    slope, slope0 = {b: T.PENALTY * v for b, v in x.items()}, 0.0
    for d, y in train.items():
        z = start + sum(float(weights[b]) for b in own[d])
        pull = (1 / (1 + math.exp(-z)) - y) * 0.5 / n[y]
        slope0 += pull
        for b in own[d] & set(ratio):
            slope[b] += pull * ratio[b]
    assert abs(slope0) < 0.02 and max(map(abs, slope.values())) < 0.02
    for r in T.score_toxicity(docs, labels).collect():
        want = 1 / (1 + math.exp(-start - sum(float(weights[b]) for b in own[r.doc_id])))
        assert r.score == pytest.approx(want, abs=1e-5) and r.predicted == (r.score >= 0.5)


def test_counts_over_many_parts(spark):
    rows = [(i, f"text number {i % 7}", i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(9)
    ones, zeros, n1, n0 = T.count_ngrams(table)
    assert (n1, n0) == (30, 30)
    for got, y in ((ones, 1), (zeros, 0)):
        want = np.zeros(1 << T.BITS)
        for _, t, k in rows:
            if k == y:
                want[list(brute_buckets(t))] += 1
        assert (got == want).all()


def test_held_out_rows(spark, small):
    """Area under the curve and recall, not only accuracy: few rows are toxic."""
    big = small.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    test = [r for r in T.score_toxicity(docs, labels).join(labels, "doc_id").collect() if r.held_out and r.toxic is not None]
    bad, good = [r.score for r in test if r.toxic], [r.score for r in test if not r.toxic]
    assert len(bad) > 5
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    assert np.mean([b >= 0.5 for b in bad]) > 0.5 and np.mean([g >= 0.5 for g in good]) < 0.06


def test_sample_is_a_bound_on_rows(spark):
    rows = [(i, "kind words here" if i % 2 else "awful nasty words", 1 - i % 2) for i in range(1, 200)] * 2
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    few, many = T.fit(labelled, 3), T.fit(labelled, 500)
    for weights, start in (few, many):
        z = [start + weights[T.ngram_buckets(t)].sum() for t in ("kind words here", "awful nasty words")]
        assert z[0] < 0 < z[1]


def test_other_labels_are_none(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, -1), (3, 2), (4, None), (5, 1), (5, 7), (None, 1)], "doc_id long, toxic int")
    known = {0: 0, 1: 1, 5: 1}
    assert {r.doc_id: r.label for r in T.labelled_documents(docs, labels).collect()} == {i: v for i, v in known.items() if zlib.crc32(str(i).encode()) % 5}
