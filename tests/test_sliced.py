"""Distances of pairs counted a bit for each pair, against one pair at a time."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from flowlab.operators import similarity as S


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def stripe(rng, number: int, words: int, longest: int, alphabet: str) -> pd.DataFrame:
    """Rows (label, word, n): words of all lengths, the empty one among them, some of several labels and often repeated."""
    found = sorted({"".join(rng.choice(list(alphabet), rng.integers(0, longest + 1))) for _ in range(words)} | {"", alphabet})
    rows = sorted({(f"L{k}", w) for w in found for k in rng.integers(0, 3, 2)})
    return pd.DataFrame({"group": "", "i": 0, "j": 1, "stripe": number, "label": [r[0] for r in rows], "word": [r[1] for r in rows], "n": rng.choice([1, 1, 1, 2, 5, 300], len(rows))})


def plain(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Counter:
    out: Counter = Counter()
    a, b = (list(zip(f["label"], f["word"], f["n"].tolist())) for f in (left, right))
    for i, (x, v, n) in enumerate(a):
        for y, w, m in b[i:] if same else b:
            pairs = n * (n - 1) // 2 if same and (x, v) == (y, w) else n * m
            out[min(x, y), max(x, y), distance(v, w)] += pairs
    return +out


@pytest.mark.parametrize("longest, lanes, rows", [(9, (1024, 4096), 1 << 17), (9, (32, 64), 1), (40, (32, 64), 1)])
@pytest.mark.parametrize("same", [True, False])
def test_pairs_counted_in_bits_are_those_of_single_pairs(monkeypatch, longest, lanes, rows, same):
    rng = np.random.default_rng(longest + same)
    left = stripe(rng, 0, 90, longest, "abcd")
    right = left if same else stripe(rng, 1, 110, longest, "bcdef")
    frame = left.assign(j=0) if same else pd.concat([left, right])
    want = plain(left, right, same)
    calls = []
    whole = S._sliced
    monkeypatch.setattr(S, "_sliced", lambda *x: calls.append(1) or whole(*x))
    monkeypatch.setattr(S, "SLICED", (0, 64))
    monkeypatch.setattr(S, "LANES", lanes)
    monkeypatch.setattr(S, "ROWS", rows)
    monkeypatch.setattr(S, "NEAR", 64 if rows == 1 else S.NEAR)
    monkeypatch.setattr(S, "PLANES", 1 if rows == 1 else S.PLANES)  # blocks of 64 words
    for few in ((0, 64), (1 << 30, 64)):  # and as few words are counted
        monkeypatch.setattr(S, "SLICED", few)
        got = S._tally(frame)
        assert {(r.label_a, r.label_b, r.dist): r.n for r in got.groupby(["label_a", "label_b", "dist"], as_index=False)["n"].sum().itertuples()} == want
    assert len(calls) == 1
