"""Encoding and decoding over several groups and buckets, with null and large ids."""

import public_tokenizers
from tokenizers import Tokenizer

from flowlab.llm import bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_groups_and_buckets(spark, monkeypatch, odd_documents):
    monkeypatch.setattr(bpe, "GROUP", 20_000)
    monkeypatch.setattr(bpe, "BUCKET", 50_000)
    monkeypatch.setattr(bpe, "DEAL", 5_000)
    texts = [r.text for r in odd_documents.collect()]
    rows = [((1 << 62) + i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = Tokenizer.from_file(BYTE)
    own.no_truncation()
    own.no_padding()
    encoded = bpe.encode(docs, BYTE)
    want = sorted((str(d), own.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(encoded, BYTE).collect()) == sorted((str(d), t or "") for d, t in rows)
    broken = spark.createDataFrame([(1, own.encode("é", add_special_tokens=False).ids[:1] + [50256], ), (2, []), (3, None)], "doc_id int, ids array<int>")
    plan = bpe.decode(broken, BYTE)
    assert {r.doc_id: r.text for r in plan.collect()} == {1: own.decode(own.encode("é", add_special_tokens=False).ids[:1] + [50256], skip_special_tokens=False), 2: "", 3: None}
