"""Substring dedup with large, negative, sparse and null ids, hot passages and small parts."""

import hashlib
import random

import pytest

from flowlab.llm import substring
from tests.llm.test_operators import brute_substring

DOCS = "doc_id long, text string"


def planted(ids):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(len(ids)):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((0, 5, 12, 13, 60, 200)))]
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + (passage * rng.choice((1, 1, 3)) if i % 3 else []) + own[at:]))
    return dict(zip(ids, texts))


def report(rows):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}


@pytest.mark.parametrize("first", [0, (1 << 62) - 50, -(1 << 63)])
def test_ids_of_64_bits(spark, monkeypatch, first):
    monkeypatch.setattr(substring, "SLOT_CHARS", 5000)
    docs = planted([first + i for i in range(150)])
    table = spark.createDataFrame(list(docs.items()), DOCS).repartition(3)
    got = substring.substring_dedup(table, batches=3).collect()
    assert len(got) == len(docs) and report(got) == brute_substring({d: t.split() for d, t in docs.items()})


def test_sparse_ids_and_rows_without_id(spark):
    rng = random.Random(5)
    docs = planted([rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)])
    text = next(t for t in docs.values() if len(t) > 400)
    table = spark.createDataFrame([*docs.items(), (None, text), (None, None)], DOCS)
    got = substring.substring_dedup(table, texts=False).collect()
    want = brute_substring({d: t.split() for d, t in docs.items()})
    assert report(r for r in got if r.doc_id is not None) == want
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is None) == sorted(
        [(0, 0, hashlib.sha256(b"").hexdigest()), (len(text.split()), 0, hashlib.sha256(" ".join(text.split()).encode()).hexdigest())]
    )


def test_copies_of_a_long_id(spark):
    """All but the first of many copies lose every word, wherever their ids lie."""
    text = " ".join(f"c{i}" for i in range(40))
    table = spark.createDataFrame([((1 << 62) + 7 * i, text) for i in range(200)], DOCS).repartition(4)
    got = sorted((r.doc_id, r.n_removed) for r in substring.substring_dedup(table, texts=False).collect())
    assert got == [((1 << 62) + 7 * i, 40 if i else 0) for i in range(200)]
