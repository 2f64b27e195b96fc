"""Suffix-array dedup: suffix arrays against sorting, the operator against brute force and its SQL."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from flowlab.llm import queries, suffix_dedup

DOCS = "doc_id long, text string"


def laid_out(strings):
    size = np.array([len(s) for s in strings])
    return np.array([c for s in strings for c in s], np.int64), np.cumsum(size) - size, size


def test_suffix_arrays_of_many_strings():
    rng = random.Random(7)
    for _ in range(150):
        strings = []
        for _ in range(rng.randint(1, 8)):
            own = [rng.randint(1, rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(0, 60))]
            strings.append((own[:6] * rng.randint(1, 9) if rng.random() < 0.4 else own) + [0])
        text, first, size = laid_out(strings)
        want = [f + i for f, s in zip(first.tolist(), strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert suffix_dedup.suffix_arrays(text, first, size).tolist() == want


def test_groups_are_lyndon_prefixes():
    """Suffixes are in one group if they begin with the same longest Lyndon word; prev is the nearest smaller group before."""
    for word in ("abcbcabcac", "graindraining", "aaaa", "bananabanana", "zyx"):
        s = [ord(c) for c in word] + [0]
        group, prev = suffix_dedup.lyndon_groups(*laid_out([s]))
        lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
        prefix = [max(tuple(s[i:j]) for j in range(i + 1, len(s) + 1) if lyndon(s[i:j])) for i in range(len(s))]
        for i in range(len(s)):
            assert all((group[i] == group[j]) == (prefix[i] == prefix[j]) and (group[i] < group[j]) == (prefix[i] < prefix[j]) for j in range(len(s)))
            assert prev[i] == max((j for j in range(i) if prefix[j] < prefix[i]), default=-1)


def test_equal_windows_have_one_anchor():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[2500:2900] = data[300:700]
    data[3000:3400] = 97
    key, first, count = suffix_dedup.anchored(data, np.array([1500, 50, 0, 2450]), 60, 24)
    starts = {int(f) + k: (int(v), int(f)) for v, f, c in zip(key, first, count) for k in range(c)}
    assert sorted(starts) == [*range(1441), *range(1550, 1550 + 2391)] and count.max() <= 60 - 24 + 1
    seen = {}
    for s, (v, f) in starts.items():
        window = data[s : s + 60].tobytes()
        assert seen.setdefault(window, v) == v
        assert len({data[f + k : f + k + 60].tobytes() for k in range(60) if starts.get(f + k, (0, -1))[1] == f}) == sum(x[1] == f for x in starts.values())


def brute(docs, width=100):
    """docs: one text for each doc_id."""
    first, out = {}, {}
    for d in sorted(docs):
        raw = docs[d].encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - width + 1):
            if first.setdefault(raw[p : p + width], (d, p)) != (d, p):
                gone[p : p + width] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect() if r.doc_id is not None}


def planted(ids, seed=4):
    """Texts with a frequent line, shared passages that are cut and edited, copies, periods and two-byte letters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    line = " ".join(word() for _ in range(30))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = []
    for i in range(len(ids)):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(2)]
        extra = [line] * (i % 3 != 0)
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = rng.randint(0, 60)
            p = p[cut : cut + rng.randint(50, 400)]
            at = rng.randint(0, len(p))
            extra.append(p[:at] + rng.choice(("", "#")) + p[at:])
        texts.append(" ".join(parts[:1] + extra + parts[1:]) if rng.random() < 0.9 or not texts else rng.choice(texts))
    texts[0], texts[1], texts[2], texts[3] = "ab" * 400, "abc" * 200, "", "x" * 99
    return dict(zip(ids, texts))


@pytest.mark.parametrize("first", [0, -(1 << 63), (1 << 62) - 3])
def test_against_brute_force(spark, monkeypatch, first):
    """Small parts, hot keys, and keys of every kind."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 9000)
    monkeypatch.setattr(suffix_dedup, "HOT", 6)
    monkeypatch.setattr(suffix_dedup, "SLOT_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "SYMBOLS", 5000)
    docs = planted([first + 3 * i for i in range(140)], seed=first % 1000)
    table = spark.createDataFrame(list(docs.items()), DOCS).repartition(4)
    result = suffix_dedup.suffix_dedup(table)
    assert got(result) == brute(docs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in result.collect())


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    docs = planted(list(range(60)))
    docs[5] = docs[10] * 4 + docs[11] + "y" * 1500
    assert got(suffix_dedup.suffix_dedup(spark.createDataFrame(list(docs.items()), DOCS).repartition(3))) == brute(docs)


def test_odd_rows(spark, odd_documents, no_documents):
    texts = {}
    for r in odd_documents.collect():
        texts[r.doc_id] = r.text or ""
    rows = [(d, t or None) for d, t in texts.items()]
    long = next(t for t in texts.values() if len(t) > 10_000)
    table = spark.createDataFrame([*rows, (4, texts[4]), (100, long), (None, long), (None, None)], DOCS)
    result = suffix_dedup.suffix_dedup(table)
    assert got(result) == brute(texts) and result.count() == len(rows) + 4
    assert sorted((r.n_bytes, r.n_removed) for r in result.collect() if r.doc_id is None) == [(0, 0), (len(long), 0)]
    assert suffix_dedup.suffix_dedup(no_documents).count() == 0


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    df = queries.op11_suffix_dedup(spark, small)
    want = con.execute(queries.ORACLES["op11_suffix_dedup"])
    assert df.columns == [c[0] for c in want.description]
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(want.fetchall()) and sum(r[2] for r in rows)
