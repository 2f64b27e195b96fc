"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import duckdb
import pytest

from flowlab.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    size = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, []).extend(terms(text))
    out = []
    for i, own in wanted.items():
        found = []
        for (d, b), s in zip(bags, size):
            if s:
                m = 25 + (75 * s * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in own if t in b)
                if score > 0:
                    found.append((-score, d is None, d or 0))
        out += [(i, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top], 1)]
    return out


def got(df):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]


def key(rows):
    return sorted(rows, key=str)


ITEMS = [(1, "plain words here"), (2, None), (3, ""), (4, "word1 word1 WORD2 café naïve x 日本語"), (5, "nowhere"), (6, "the secret: token"), (6, "tail words"), (None, "twice lead")]


def test_against_brute_force(spark, small, odd_documents):
    odd = odd_documents.select("doc_id", "text", "lang", "n_chars")
    odd = odd.union(spark.createDataFrame([(None, "plain words here", "x", 1), (None, "word1", "x", 1), (-(1 << 62) - 7, "word1 word2", "x", 1), ((1 << 62) + 7, "plain words here", "x", 1)], odd.schema))
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert key(got(lexical.ranked_search(odd, items))) == key(brute([(r.doc_id, r.text) for r in odd.collect()], ITEMS))


def test_blocks_of_items_and_small_steps(spark, small, monkeypatch):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = key(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3))
    monkeypatch.setattr(lexical, "ITEMS", 20)
    monkeypatch.setattr(lexical, "SCORES", 50)
    assert key(got(lexical.ranked_search(docs, items, 3))) == want


def test_ties_of_many_copies(spark):
    """A class of many copies shows its smallest ids; an equal score of another class comes between them by id."""
    docs = [(i, "alpha beta" if i % 3 else "beta alpha") for i in range(400)] + [(1000 + i, f"gamma{i} delta") for i in range(50)] + [(900 - i, "alpha gamma1") for i in range(3)]
    items = [(1, "alpha"), (2, "alpha gamma7 gamma7"), (3, "delta")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert key(got(lexical.ranked_search(table, spark.createDataFrame(items, "item_id int, text string")))) == key(brute(docs, items))


def test_empty_tables(spark, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical.ranked_search(no_documents, items).count() == 0
    assert lexical.ranked_search(no_documents, items.limit(0)).count() == 0


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.op13_ranked_search(spark, small)
    want = con.execute(queries.ORACLES["op13_ranked_search"])
    assert df.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
