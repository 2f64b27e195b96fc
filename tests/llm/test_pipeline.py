"""The pipeline against its stages done by brute force, and each stage on odd tables."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlab.llm import secret_scan
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import brute_spans


def marked(text):
    out, at = "", 0
    for a, _, b in brute_spans(text, secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        if a >= at:
            out, at = out + text[at:a] + "[SECRET]", b
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs = {d: t for d, t in docs.items() if any(c.isalpha() for c in t)}
    last = {t: d for d, t in sorted(docs.items())}
    docs = {d: t for t, d in last.items()}
    kept = brute_kept(docs)
    assert len(kept) < len(docs)
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d in kept:
        ids = own.encode(marked(docs[d]), add_special_tokens=False).ids + [1]
        want |= {(d, i // 4096, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[i : i + 4096]))) for i in range(0, len(ids), 4096)}
    got = corpus_pipeline.run(spark, small).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in got} == want and len(got) == len(want)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= 1.01 * sum(fill.values()) / 4096 + 2


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.dtypes == docs.dtypes, name
        assert re.fullmatch(r"\w+", name)


@pytest.fixture(scope="module")
def odd(spark, odd_documents):
    """Odd texts with names that the stages use themselves, large ids, rows without an id, repeated rows."""
    names = ["__spans", "__rules", "__id", "__digest", "kept", "digest", "node", "component", "first", "lang_pred", "score", "block", "room", "length", "piece"]
    rows = odd_documents.withColumn("doc_id", F.col("doc_id") + F.lit(1 << 62)).select("doc_id", "text", "lang")
    more = spark.createDataFrame([(None, "a text without an id, token = abcdefghijklmnop1234"), (None, None), (None, "a text without an id, token = abcdefghijklmnop1234"), (5, "only 1 text"), (5, "quite another text"), (5, "only 1 text")], "doc_id long, text string")
    rows = rows.unionByName(more.withColumn("lang", F.lit("en")))
    return rows.withColumns({n: F.lit(i) for i, n in enumerate(names)})


def brute_stages(rows):
    """(doc_id, text) rows after language, exact, near and secrets."""
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t.lower())]
    best = {}
    for d, t in rows:
        if t not in best or best[t] is None or d is not None and d > best[t]:
            best[t] = d
    rows = [(d, t) for t, d in best.items()]
    kept = brute_kept(dict(enumerate(t for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return [(d, marked(t)) for i, (d, t) in enumerate(rows) if i in kept]


def test_odd_rows_go_through_all_stages(spark, odd, small):
    docs = odd
    want = Counter(brute_stages([(r.doc_id, r.text) for r in odd.collect()]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd.columns, name
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == want
    got = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter((d, len(own.encode(t, add_special_tokens=False).ids) + 1) for d, t in want.elements())
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert total == Counter({d: sum(n * k for (e, n), k in lengths.items() if e == d) for d in {d for d, _ in want}})


def test_empty_table(spark, odd, small):
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0, name


def test_unlabelled_corpus_stays(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = corpus_pipeline.run(spark, small).select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == want > 100
