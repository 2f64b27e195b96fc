"""Cross-parsing against a parse by substring search, kernel and whole operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import langid


def model_of(texts):
    """One language's automaton of symbol lists (each after a 0)."""
    stream = np.array([s for t in texts for s in [0, *t]] + [0])
    points = np.unique(stream)
    packed = langid.displace(*langid.suffix_automaton(np.searchsorted(points, stream).tolist()), len(points))
    row = {k: v.astype(np.int32).tobytes() for k, v in zip(("base", "owner", "next"), packed)}
    return stream.tolist(), row | {"points": points.astype(np.uint32).tobytes(), "size": len(stream)}


def brute_phrases(symbols, own):
    """Longest substrings of `own` one after another; an unknown symbol is a phrase."""
    text = "".join(chr(s + 1) for s in own)
    row = "".join(chr(s + 1) for s in symbols)
    count = at = 0
    while at < len(row):
        size = 1
        while at + size < len(row) and row[at : at + size + 1] in text:
            size += 1
        count, at = count + 1, at + size
    return count


@pytest.mark.parametrize("segment", [3, 16, 4096])
def test_phrases(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = np.random.default_rng(3)
    streams, rows = zip(*(model_of([rng.choice(letters, 120).tolist() for _ in range(3)]) for letters in ([1, 2, 3], [2, 3, 4, 5], [7])))
    models = langid.join_models([r | {"lang": name} for r, name in zip(rows, "abc")])
    texts = [[0, *rng.choice([1, 2, 3, 4, 5, 9], n).tolist()] for n in (0, 1, 7, 64, 200)] + [streams[0][5:90], [0] + [7] * 300]
    bounds = np.cumsum([0, *map(len, texts)])
    got = langid.phrases(models, models.symbols(np.concatenate([np.array(t, np.uint32) for t in texts])), bounds)
    assert got.tolist() == [[brute_phrases(t, s) for t in texts] for s in streams]


def brute_fold(text):
    out = [0]
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c))
        elif out[-1]:
            out.append(0)
    return out


def test_fold_texts():
    texts = ["", "  ", "Ab, c!", "\u0130 \U00010400x", "a", "..a..b.."]
    symbols, bounds, letters = langid.fold_texts(texts)
    assert [symbols[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [brute_fold(t) for t in texts]
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in texts]


def test_whole_operator(spark, small):
    """Predictions and scores of short documents, recomputed from the rows that learn() says it takes."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.withColumn("h", F.xxhash64("doc_id")).collect()}
    held = {r.doc_id for r in docs.where(langid.held_out()).collect()}
    sample = 5
    own = {}
    for lang in sorted({r.lang for r in rows.values() if r.lang}):
        known = [r for d, r in rows.items() if d not in held and r.lang == lang]
        far = lambda n: 200 - n if n < 200 else max(0, n - 2000)
        chosen = sorted(known, key=lambda r: (far(len(r.text or "")), r.h, r.doc_id))[:sample]
        own[lang] = [s for r in chosen for s in brute_fold(r.text or "")] + [0]
    got = langid.language_report(docs, sample).collect()
    assert len(got) == len(rows)
    for r in sorted(got, key=lambda r: r.doc_id)[:40]:
        text = rows[r.doc_id].text or ""
        if not any(c.isalpha() for c in text) or len(text) > 3000:
            continue
        need = {lang: brute_phrases(brute_fold(text), s) * math.log2(len(s)) for lang, s in own.items()}
        best, second = sorted(need.values())[:2]
        assert r.lang_pred == min(need, key=lambda k: (need[k], k)) and r.score == pytest.approx(1 - best / second)


def test_many_symbols_and_other_scripts(spark):
    chinese = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(900))
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(chinese, "zh"), ("\u0435\u0449\u0451 \u0442\u0435\u043a\u0441\u0442 " * 40, "ru"), ("plain words of a text " * 20, "en")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, chinese[100:130]), (2, "\u0442\u0435\u043a\u0441\u0442"), (3, "a plain text"), (None, "words"), (4, "12")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict_language(asked, docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "zh"), (2, "ru"), (3, "en"), (None, "en"), (4, "und")], key=str)
