"""The pipeline's near-dedup stage against all pairs by brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import simhash

DOCS = "doc_id long, text string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_kept(docs):
    """The smallest id of each component of pairs at 0.8 or more."""
    sets = {d: shingles(t) for d, t in docs.items()}
    label = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if label[b] < label[a] and alike(sets[a], sets[b]):
                    label[a], changed = label[b], True
    return {d for d in docs if label[d] == d}


def planted():
    """60 texts with edited copies at 0.7 to 0.97, short ones, and empty ones."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = {}
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(40, 300))]
        docs[len(docs)] = " ".join(base)
        for _ in range(rng.randint(1, 3)):
            own = list(base)
            for _ in range(rng.randint(1, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = "new"
            docs[len(docs)] = " ".join(own)
    for t in ("", " \t", None, "one two", "One  Two", "one two three"):
        docs[len(docs)] = t
    return docs


def test_edited_copies_leave(spark):
    docs = planted()
    sets = {d: shingles(t) for d, t in docs.items()}
    some = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in docs for b in docs if a < b and sets[a] and sets[b] and alike(sets[a], sets[b])]
    assert sum(0.8 <= x < 0.95 for x in some) > 30
    got = simhash.drop_near_copies(spark.createDataFrame(list(docs.items()), DOCS)).collect()
    assert {r.doc_id for r in got} == brute_kept(docs) and len(got) == len(brute_kept(docs))


def test_stage_on_the_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert got == brute_kept({r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("few", [2, 1000])
def test_large_bands_and_strangers_in_them(spark, monkeypatch, few):
    """Bands over HEAVY: their first and last are tested first, all others that could join components after."""
    monkeypatch.setattr(simhash, "HEAVY", 3)
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    monkeypatch.setattr(simhash, "MINIMA", 1)
    monkeypatch.setattr(simhash, "FACTORS", simhash.FACTORS[: simhash.BANDS])
    docs = planted()
    got = simhash.drop_near_copies(spark.createDataFrame(list(docs.items()), DOCS).repartition(3)).collect()
    assert {r.doc_id for r in got} == brute_kept(docs)


def test_rows_of_one_id_are_judged_apart(spark):
    base = " ".join(f"a{i}" for i in range(60))
    near, other = base + " tail", " ".join(f"b{i}" for i in range(60))
    rows = [(1, base), (2, near), (2, other), (None, near + " end"), (None, "a text alone"), (3, "twice"), (3, "twice")]
    got = Counter(tuple(r) for r in simhash.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter([(1, base), (2, other), (None, "a text alone"), (3, "twice")])


def test_no_rows(spark):
    assert simhash.drop_near_copies(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.drop_near_copies(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).count() == 1


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 40), (30, 0, 1, 50)))
    assert simhash.shared_counts(left, right).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]


def test_edited_copies_of_one_text(spark):
    """A star of copies that are alike to the first text and not to each other, with some that are alike to none."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(200)]
    docs = {0: " ".join(base)}
    for i in range(1, 120):
        own = list(base)
        for _ in range(rng.choice((1, 3, 5, 7, 9))):
            own[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        docs[i] = " ".join(own)
    got = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    assert got == brute_kept(docs) and 1 < len(got) < 119


def test_links_of_fingerprints_are_candidates(spark):
    """Fingerprints within 2 bits meet through the trie, whatever their bands: here no two rows share a band."""
    marks = [0, 0, 3, 7, 1 << 63, 0x7FFF, 0x7FFF << 8]
    rows = [(10 + i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(marks)]
    got = {tuple(sorted(r)) for r in simhash.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()}
    assert got == {(10, 11), (10, 12), (12, 13), (10, 14)}


def test_stage_takes_the_trie(spark):
    """Near copies leave also where the bands give no candidate at all."""
    base = [f"w{i}" for i in range(4000)]
    docs = {0: " ".join(base), 1: " ".join([*base, "tail"]), 2: " ".join(f"x{i}" for i in range(50))}
    classes = simhash.shingle_classes(spark.createDataFrame(list(docs.items()), DOCS), 5)
    classes = classes.withColumn("bands", F.array(F.col("doc_id"))).drop("doc_id").cache()
    found = simhash.similar_components(spark.createDataFrame(list(docs.items()), DOCS), classes, 5, 0.8).collect()
    assert len(found) == 2 and len({r.component for r in found}) == 1


def test_the_trie_is_not_one_plan(spark):
    """The driver holds the plan of a few depths of the trie at a time; the pairs are those of the trie in one plan."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    fps = sorted(set(base + [b ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for b in base]))
    nodes = {fp: n for n, fp in enumerate(fps)}
    rows = spark.createDataFrame([(n, fp) for fp, n in nodes.items()], "node long, fp long")
    found = simhash.fingerprint_pairs(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") < 12
    whole = {tuple(sorted((nodes[r.a], nodes[r.b]))) for r in simhash.trie_pairs(rows.select("fp")).collect()}
    assert {tuple(sorted(r)) for r in found.collect()} == whole and len(whole) >= 40
