"""Cross-tokenizer alignment against whole texts encoded by both libraries."""

import hashlib
import re
from bisect import bisect
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from flowlab.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def token_bytes():
    """Bytes of A's tokens by its own decoder, of B's by its pieces."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in visible}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    return lambda piece: bytes(back[c] for c in piece), lambda piece: bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def brute(docs):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_a, bytes_b = token_bytes()
    found = []
    for doc_id, text in docs:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            left, right = [bytes_a(t) for t in x.tokens], [bytes_b(b.id_to_piece(i)) for i in y]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                ends = [np.cumsum([len(p) for p in s]).tolist() for s in (left, right)]
                common = sorted(set(ends[0]) & set(ends[1]))
                at, ids = [0, 0], x.ids
                for end in common:
                    to = [bisect(e, end) for e in ends]
                    groups.append((ids[at[0] : to[0]], y[at[1] : to[1]]))
                    at = to
        found.append((doc_id, groups))
    pairs = [Counter((i, j) for one, other in g for i in one for j in other) for _, g in found]
    count = Counter(p for own in pairs for p in own)
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (doc_id, groups), own in zip(found, pairs):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = ["a  b   c ", " lead", "  two ", " ", "\n", " \n x", "tab\t x\n y", "a▁b", "▁", "<s> x</s><unk> <|endoftext|>", "x\x00y​z", "  wide　 space", "ünï " * 30, "();\r\n  {\r}", "é ́ x", "  a\x1c b"]


def test_odd_texts(spark, odd_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()] + [(500 + i, t) for i, t in enumerate(ODD)] + [(None, "plain words here"), ((1 << 62) + 3, "plain words"), (None, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(alignment.align_tokens(table, A, B, groups=True)) == brute(docs)


def test_small_runs_parts_and_several_merges(spark, small, monkeypatch):
    """Many short runs, few words held, merges of two runs at a time: the same result."""
    for name, value in (("RUN_CHARS", 20_000), ("WORDS", 500), ("FAN_IN", 2), ("PART_CHARS", 30_000)):
        monkeypatch.setattr(alignment, name, value)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert got(alignment.align_tokens(docs.repartition(3), A, B, groups=True)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_merge_of_runs():
    runs = [(np.array([1, 5, 9]), np.array([2, 1, 1])), (np.array([5]), np.array([4])), (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.array([0, 9]), np.array([1, 1]))]
    pairs, totals = alignment.merged(runs)
    assert pairs.tolist() == [0, 1, 5, 9] and totals.tolist() == [1, 2, 5, 2]


def test_no_rows(no_documents):
    assert alignment.align_tokens(no_documents, A, B).count() == 0
