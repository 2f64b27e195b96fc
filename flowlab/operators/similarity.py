"""Edit distances between coded sequences: neighbours, label pairs, medians. Equal sequences are joined once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.symbols import code_symbol
from flowlab.operators.evaluation import vote
from flowlab.sources.storage import materialise


#: Symbols of a vocabulary that is looked up in the row.
SHORT = 256


def vocabulary(seqs: DataFrame) -> DataFrame:
    """(symbol, id): the distinct symbols of array sequences, densely numbered in order."""
    return seqs.select(F.explode("seq").alias("symbol")).distinct().withColumn("id", F.row_number().over(Window.orderBy("symbol")) - 1)


def encode(seqs: DataFrame, vocab: DataFrame, key: str = "flow_id") -> DataFrame:
    """seqs with `ids`, -1 for symbols outside the vocabulary, and `word`, a character for each id. A short vocabulary is looked up in the row."""
    short = vocab.select("symbol", "id").limit(SHORT + 1).collect()
    if 0 < len(short) <= SHORT:
        known = F.lit([r.symbol for r in sorted(short, key=lambda r: r.id)])
        ids = F.transform("seq", lambda x: F.coalesce(F.array_position(known, x) - 1, F.lit(-1)).cast("int"))
        rows = seqs.where(F.size("seq") > 0).withColumn("ids", ids)
        return rows.withColumn("word", F.array_join(F.transform("ids", code_symbol), ""))
    rows = seqs.select(key, F.posexplode("seq").alias("pos", "symbol")).join(vocab, "symbol", "left")
    ids = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(-1)).alias("id")))), lambda x: x["id"]).alias("ids"))
    return seqs.join(ids.withColumn("word", F.array_join(F.transform("ids", code_symbol), "")), key)


#: Words of a stripe, at least and at most: a group of words is cut into up to MOST_STRIPES of them, more only where they would hold too many.
#: The pairs of stripes are dealt out over up to MOST_TASKS tasks, as they are many for the few bytes that Spark sees.
STRIPE, MOST_STRIPES, MOST_TASKS = (2048, 65_536), 24, 300
#: Words of the two sides that are measured at once.
PATTERNS, TEXTS = 1024, 256


class Scratch:
    """Arrays that a worker uses again and again, by name: fresh memory for each block is slow where many tasks ask for it."""

    def __init__(self):
        self.held: dict = {}

    def __call__(self, name: str, shape: tuple, kind) -> np.ndarray:
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        if size > len(self.held.get(name, b"")):
            self.held[name] = np.empty(size, np.uint8)
        return self.held[name][:size].view(kind).reshape(shape) if size else np.empty(shape, kind)


SCRATCH = Scratch()


class Coded:
    """Words as rows of dense symbol ids, from a vocabulary that two sides share."""

    def __init__(self, words: list[str], symbols: np.ndarray | None = None):
        self.lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.symbols = np.unique(flat) if symbols is None else symbols
        known = len(self.symbols)
        at = np.minimum(np.searchsorted(self.symbols, flat), max(known - 1, 0))
        self.ids = np.full((len(words), int(self.lengths.max(initial=0))), known, np.int32)
        self.ids[np.arange(self.ids.shape[1]) < self.lengths[:, None]] = np.where(self.symbols[at] == flat, at, known) if known else known
        self.tries: dict = {}

    def trie(self, rows: slice) -> list[tuple[np.ndarray, ...]]:
        """For each depth the distinct prefixes of a block of words, those that go on first: (their parents, their last symbols, words that
        end there, prefixes of these)."""
        key = rows.indices(len(self.ids))
        if key not in self.tries:
            ids, lengths = self.ids[rows], self.lengths[rows]
            node, out = np.zeros(len(ids), np.int64), []
            for j in range(int(lengths.max(initial=0))):
                on = np.flatnonzero(lengths > j)
                _, first, place = np.unique(node[on] * (len(self.symbols) + 1) + ids[on, j], return_index=True, return_inverse=True)
                parents, symbols = node[on[first]], ids[on[first], j]
                node[on] = place
                ends = np.flatnonzero(lengths == j + 1)
                out.append((parents, symbols, ends, node[ends]))
            self.tries[key], place = [], np.zeros(1, np.int64)
            for (parents, symbols, ends, at), after in zip(out, [*(p for p, *_ in out[1:]), []]):
                inner = np.bincount(np.asarray(after, np.int64), minlength=len(symbols)) > 0
                order = np.argsort(~inner, kind="stable")
                parents, place = place[parents], np.argsort(order)
                self.tries[key].append((parents[order], symbols[order], ends, place[at]))
        return self.tries[key]


class Patterns:
    """Words as bit masks of each symbol's places, in integers as wide as the longest word, several of them for longer ones. The last
    place of a word that fits one integer is its top bit."""

    def __init__(self, coded: Coded, rows):
        ids, self.lengths = coded.ids[rows], coded.lengths[rows]
        most = int(self.lengths.max(initial=0))
        self.kind, self.width = next((t, w) for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if w >= most or w == 64)
        self.parts = max(1, -(-most // self.width))
        self.table = np.zeros((self.parts, len(coded.symbols) + 1, len(ids)), self.kind)
        row = np.arange(len(ids))
        first = self.width - self.lengths if self.parts == 1 else np.zeros(len(ids), np.int64)
        self.start = np.zeros(len(ids), self.kind)
        for place in range(most):  # a column has one place of each word: no two of its bits meet
            here = self.lengths > place
            bit = np.left_shift(self.kind(1), ((first[here] + place) % self.width).astype(self.kind))
            self.table[place // self.width, ids[here, place], row[here]] |= bit
            self.start[here] |= bit
        self.table[:, -1] = 0

    def distances(self, coded: Coded, rows) -> np.ndarray:
        """Edit distances of some words (rows) to the patterns (columns). The columns of the table of edits are bit vectors of
        their differences, moved by one character at a time, for all pairs at once; words with a common prefix share its columns."""
        trie, lengths = coded.trie(rows), coded.lengths[rows]
        most = max(int(self.lengths.max(initial=0)), int(lengths.max(initial=0)))
        found = np.empty((len(lengths), len(self.lengths)), np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
        found[lengths == 0] = self.lengths
        return (self._one if self.parts == 1 else self._several)(trie, found)

    def _one(self, trie: list, found: np.ndarray) -> np.ndarray:
        """Of patterns in one integer each. The last row of the table of edits is kept as numbers, moved by the top bits; bits below a
        word's first place stay as they are, as nothing matches there. A prefix that does not go on needs no column."""
        kind, sign = self.kind, np.dtype(self.kind).str.replace("u", "i")
        shape = max([len(t[1]) for t in trie], default=0), len(self.lengths)
        old, new = (SCRATCH(name, (2, max(shape[0], 1), shape[1]), kind) for name in ("old", "new"))
        far, now = (SCRATCH(name, (max(shape[0], 1), shape[1]), found.dtype) for name in ("far", "now"))
        new[0, 0], new[1, 0], now[0] = self.start, 0, self.lengths
        x, d, hp, hn = (SCRATCH(name, shape, kind) for name in ("x", "d", "hp", "hn"))
        flag = SCRATCH("flag", shape, bool)
        goes_on = [*(int(t[0].max(initial=-1)) + 1 for t in trie[1:]), 0]
        for inner, (parents, symbols, ends, at) in zip(goes_on, trie):
            new, old, now, far, c = old, new, far, now, len(symbols)
            vp, vn, total, X, D, P, N, up = new[0, :c], new[1, :c], now[:c], x[:c], d[:c], hp[:c], hn[:c], flag[:c]
            np.take(old[0], parents, axis=0, out=vp, mode="clip")
            np.take(old[1], parents, axis=0, out=vn, mode="clip")
            np.take(far, parents, axis=0, out=total, mode="clip")
            np.take(self.table[0], symbols, axis=0, out=X, mode="clip")
            np.bitwise_and(X, vp, out=D)
            np.add(D, vp, out=D)
            np.bitwise_xor(D, vp, out=D)
            np.bitwise_or(D, X, out=D)
            np.bitwise_or(D, vn, out=D)
            np.bitwise_or(D, vp, out=P)
            np.invert(P, out=P)
            np.bitwise_or(P, vn, out=P)
            np.bitwise_and(D, vp, out=N)
            total += np.less(P.view(sign), 0, out=up).view(np.uint8)
            total -= np.less(N.view(sign), 0, out=up).view(np.uint8)
            found[ends] = total[at]
            vp, vn, D, P, N = (z[:inner] for z in (vp, vn, D, P, N))
            np.add(P, P, out=P)
            np.bitwise_or(P, kind(1), out=P)
            np.add(N, N, out=N)
            np.bitwise_and(P, D, out=vn)
            np.bitwise_or(D, P, out=D)
            np.invert(D, out=D)
            np.bitwise_or(N, D, out=vp)
        return found

    def _several(self, trie: list, found: np.ndarray) -> np.ndarray:
        m, kind, width = self.lengths, self.kind, self.width
        one, top = kind(1), kind(width - 1)
        bits = [np.clip(m - w * width, 0, width).astype(np.uint64) for w in range(self.parts)]
        masks = [np.where(b == 64, ~np.uint64(0), (np.uint64(1) << (b & np.uint64(63))) - np.uint64(1)).astype(kind) for b in bits]
        nodes = max([len(t[1]) for t in trie], default=0)
        old, new = (np.empty((2, self.parts, max(nodes, 1), len(m)), kind) for _ in range(2))
        new[0, :, 0], new[1, :, 0] = np.iinfo(kind).max, 0
        x, d, hp, hn = (np.empty((nodes, len(m)), kind) for _ in range(4))
        for j, (parents, symbols, ends, at) in enumerate(trie):
            old, new, c = new, old, len(symbols)
            X, D, P, N = x[:c], d[:c], hp[:c], hn[:c]
            carry = up = down = None
            for w in range(self.parts):
                vp, vn = new[0, w, :c], new[1, w, :c]
                np.take(old[0, w], parents, axis=0, out=vp, mode="clip")
                np.take(old[1, w], parents, axis=0, out=vn, mode="clip")
                np.take(self.table[w], symbols, axis=0, out=X, mode="clip")
                eq = X | down if w else X
                np.bitwise_and(eq, vp, out=D)
                np.add(D, vp, out=D)
                over = D < vp
                if w:
                    D += carry
                    over |= (D == 0) & (carry > 0)
                carry = over.astype(kind)
                np.bitwise_xor(D, vp, out=D)
                np.bitwise_or(D, eq, out=D)
                np.bitwise_or(D, vn, out=D)
                np.bitwise_or(D, vp, out=P)
                np.invert(P, out=P)
                np.bitwise_or(P, vn, out=P)
                np.bitwise_and(D, vp, out=N)
                out = P >> top, N >> top
                np.add(P, P, out=P)
                np.add(N, N, out=N)
                np.bitwise_or(P, up if w else one, out=P)
                if w:
                    np.bitwise_or(N, down, out=N)
                np.bitwise_or(X, vn, out=X)
                np.bitwise_or(X, D, out=D)
                np.bitwise_and(P, D, out=vn)
                np.bitwise_or(D, P, out=D)
                np.invert(D, out=D)
                np.bitwise_or(N, D, out=vp)
                up, down = out
            if len(ends):
                total = np.full((len(ends), len(m)), j + 1, found.dtype)
                for w, mask in enumerate(masks):
                    total += np.bitwise_count(new[0, w, at] & mask)
                    total -= np.bitwise_count(new[1, w, at] & mask)
                found[ends] = total
        return found


class Side:
    """The distinct words of a stripe in order of their length (or of their letters, so that a block shares more prefixes), its rows as
    (word, number), and blocks of words."""

    def __init__(self, frame: pd.DataFrame, block: int, symbols: np.ndarray | None = None, by_length: bool = True):
        self.words = sorted(set(frame["word"]), key=(lambda w: (len(w), w)) if by_length else None)
        self.coded = Coded(self.words, symbols)
        place = {w: i for i, w in enumerate(self.words)}
        at = np.array([place[w] for w in frame["word"]], np.int64)
        self.order = np.argsort(at, kind="stable")
        self.at = at[self.order]
        self.blocks = [(lo, min(lo + block, len(self.words))) for lo in range(0, len(self.words), block)]

    def rows(self, lo: int, hi: int) -> slice:
        """The rows, in `order`, of the words of a block."""
        return slice(*np.searchsorted(self.at, (lo, hi)))

    def weights(self, lo: int, hi: int, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes that occur in a block, how often each word has them)."""
        own = self.rows(lo, hi)
        rows = self.order[own]
        present, column = np.unique(code[rows], return_inverse=True)
        out = np.zeros((hi - lo, len(present)), np.int64)
        np.add.at(out, (self.at[own] - lo, column), n[rows])
        return present, out

    def spread(self, lo: int, hi: int, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word in the block, place of the code among those that occur, number) of the block's rows."""
        own = self.rows(lo, hi)
        rows = self.order[own]
        return self.at[own] - lo, np.unique(code[rows], return_inverse=True)[1], n[rows].astype(float)


#: Rows a word pair may have on average where pairs are counted singly; else the labels' sums are products of tables.
MOST_SPREAD = 3


#: So many words at least, up to this length, are counted by `Sliced`; fewer are faster one by one. Patterns that are measured at once, at least (of one length there may be fewer) and at most; words, as many
#: as make arrays of so many integers; and the integers of those arrays that are used again at once, which stay in the processor's cache.
SLICED, LANES, ROWS, NEAR = (2500, 64), (1024, 4096), 1 << 17, 1 << 14


#: Bytes of all planes of a block of words and patterns, of which there are two sets.
PLANES = 1 << 26


def _powers(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code * 64 + k): each row once for each power 2^k of two that its number n has."""
    bits = (n[:, None] >> np.arange(max(int(n.max(initial=1)).bit_length(), 1))) & 1
    row, k = np.nonzero(bits)
    return row, code[row] * 64 + k


class Sliced:
    """Patterns, a bit each, ordered by length: 64 of them lie in one integer, those of a length, label and power of two (`groups`) side by side.
    All cells of the table of edits are differences of one, as two bits, so one operation moves a cell of 64 pairs. Words end in the last row;
    the rows before a shorter word's first are like the table's edge, as no bit of them is ever set."""

    def __init__(self, coded: Coded, words: np.ndarray, groups: np.ndarray):
        lengths = coded.lengths[words]
        first = np.flatnonzero(np.append(True, (groups[1:] != groups[:-1]) | (lengths[1:] != lengths[:-1])))
        sizes = np.diff(np.append(first, len(words)))
        self.groups, self.lengths, self.length = groups[first], lengths[first], int(lengths.max(initial=0))
        self.unit = np.uint64 if sizes.mean() > 256 else np.uint16  # groups begin with a new one
        unit = 8 * np.dtype(self.unit).itemsize
        room = -(-sizes // unit)
        self.starts, self.width = np.cumsum(room) - room, int(-(-room.sum() * unit // 64))
        slot = np.repeat(self.starts * unit - first, sizes) + np.arange(len(words))
        ids = np.full((self.length, self.width * 64), -1)
        shift = self.length - lengths
        for i in range(self.length):
            here = shift <= i
            ids[i, slot[here]] = coded.ids[words[here], i - shift[here]]
        valid = np.zeros(self.width * 64, bool)
        valid[slot] = True
        self.valid, self.edge = self._bits(valid), self._bits(ids >= 0)
        self.table = [self._bits(np.append(np.arange(len(coded.symbols)), -2)[:, None] == row) for row in ids]

    @staticmethod
    def _bits(x: np.ndarray) -> np.ndarray:
        return np.packbits(x, axis=-1, bitorder="little").view(np.uint64)

    def count(self, trie: list, entries: list, planes: int, total: np.ndarray) -> None:
        """Adds to total (label of the words, of the patterns, distance) the pairs of a block of words: their trie, and for each depth, 0 first, the (nodes,
        groups, where these begin) of the words that end there."""
        m, w, kind = self.length, self.width, np.uint64
        most, step = max([1, *(len(t[1]) for t in trie)]), max(1, NEAR // w)
        old, new = (SCRATCH(name, (2 * m + planes, most, w), kind) for name in ("sliced old", "sliced new"))
        near = [SCRATCH(name, (step, w), kind) for name in ("hp", "hn", "eq", "x", "y")]
        new[:m, 0], new[m:, 0] = self.edge, 0
        self._tally(new[2 * m :], 0, entries[0], total)
        goes_on = [*(int(t[0].max(initial=-1)) + 1 for t in trie[1:]), 0]
        for depth, (go, (parents, symbols, _, _)) in enumerate(zip(goes_on, trie), 1):
            old, new = new, old
            for lo in range(0, len(symbols), step):
                hi = min(lo + step, len(symbols))
                self._column(old, new[:, lo:hi], parents[lo:hi], symbols[lo:hi], max(min(go, hi) - lo, 0), planes, [z[: hi - lo] for z in near])
            self._tally(new[2 * m :], depth, entries[depth], total)

    def _column(self, old, new, parents, symbols, go: int, planes: int, near: list) -> None:
        """The columns of some prefixes from those of their parents; only the first `go` of them go on. The last planes are sums."""
        m, (HP, HN, E, X, Y) = self.length, near
        HP[:], HN[:] = ~np.uint64(0), 0
        for i in range(m):
            P, M = new[i], new[m + i]
            old[i].take(parents, axis=0, out=P, mode="clip")
            old[m + i].take(parents, axis=0, out=M, mode="clip")
            self.table[i].take(symbols, axis=0, out=E, mode="clip")
            np.bitwise_or(E, HN, out=X)  # the way across
            np.bitwise_or(X, P, out=Y)
            np.invert(Y, out=Y)
            np.bitwise_or(Y, M, out=Y)
            np.bitwise_and(X, P, out=X)
            if go:  # the way down
                e, p, n, up = E[:go], P[:go], M[:go], HP[:go]
                np.bitwise_or(e, n, out=e)
                np.bitwise_or(e, up, out=p)
                np.invert(p, out=p)
                np.bitwise_or(p, HN[:go], out=p)
                np.bitwise_and(e, up, out=n)
            (HP, Y), (HN, X) = (Y, HP), (X, HN)
        # the sums of the last row's differences and 1, which are 0, 1 or 2: low and high bit
        low, carry = X, Y
        np.bitwise_or(HP, HN, out=low)
        np.invert(low, out=low)
        for k in range(planes):
            S = new[2 * m + k]
            old[2 * m + k].take(parents, axis=0, out=S, mode="clip")
            if k == 0:
                np.bitwise_and(S, low, out=carry)
                np.bitwise_xor(S, low, out=S)
            elif k == 1:
                np.bitwise_and(S, HP, out=E)
                np.bitwise_xor(S, HP, out=S)
                np.bitwise_and(S, carry, out=low)
                np.bitwise_xor(S, carry, out=S)
                np.bitwise_or(E, low, out=carry)
            else:
                np.bitwise_and(S, carry, out=E)
                np.bitwise_xor(S, carry, out=S)
                carry, E = E, carry

    def _tally(self, sums: np.ndarray, depth: int, entries, total: np.ndarray) -> None:
        nodes, groups, starts = entries
        if not len(nodes):
            return
        own, m = sums[:, nodes], self.lengths
        other = ~own
        power, labels = (groups & 63)[:, None] + (self.groups & 63)[None], np.broadcast_arrays((groups >> 6)[:, None], (self.groups >> 6)[None])
        # a sum is a distance less the pattern's length, and the word's more
        least, most = max(0, 2 * (depth - int(m.max()))), max(depth, 2 * depth - int(m.min()))

        def split(plane: int, code: int, mask: np.ndarray) -> None:
            """The pairs of mask, whose sums have the bits of code from plane + 1 on."""
            if code > most or code + (1 << plane + 1) <= least:
                return
            if plane >= 0:
                split(plane - 1, code, mask & other[plane])
                split(plane - 1, code + (1 << plane), mask & own[plane])
                return
            found = np.add.reduceat(np.add.reduceat(np.bitwise_count(mask.view(self.unit)), starts, axis=0, dtype=np.int64), self.starts, axis=1)
            np.add.at(total, (*labels, np.broadcast_to(np.clip(code + m - depth, 0, total.shape[2] - 1), found.shape)), found << power)

        split(len(own) - 1, 0, np.broadcast_to(self.valid, own.shape[1:]))


def _sliced(a: Coded, b: Coded, own: tuple, other: tuple, labels: int) -> np.ndarray:
    """(label of b's rows, of a's rows, distance): how many pairs of rows there are. own, other: rows (word, label, number) of a and of b, whose
    words are in order of their letters."""
    far = 1 + max(int(c.lengths.max(initial=0)) for c in (a, b))
    total = np.zeros((labels, labels, far), np.int64)
    row, group = _powers(own[1], own[2])
    word = own[0][row]
    order = np.lexsort((word, group, a.lengths[word]))
    word, group = word[order], group[order]
    ends = np.flatnonzero(np.append(np.diff(a.lengths[word]) > 0, True)) + 1
    patterns, at = [], 0
    while at < len(word):
        to = ends[min(np.searchsorted(ends, at + LANES[0]), len(ends) - 1)]  # whole lengths, but not too many words
        to = int(min(to, at + (LANES[1] if a.lengths[word[min(to, at + LANES[1]) - 1]] <= 16 else LANES[0])))
        patterns.append(Sliced(a, word[at:to], group[at:to]))
        at = to
    row, group = _powers(other[1], other[2])
    word = other[0][row]
    order = np.lexsort((group, word))
    word, group = word[order], group[order]
    planes = max(2, (2 * int(b.lengths.max(initial=0))).bit_length())
    size = max(512, ROWS * len(patterns) // max(sum(p.width for p in patterns), 1))
    size = max(64, min(size, PLANES // max((2 * p.length + planes) * p.width * 8 for p in patterns)))
    for lo in range(0, len(b.lengths), size):
        block = slice(lo, min(lo + size, len(b.lengths)))
        trie = b.trie(block)
        node = np.zeros(block.stop - lo, np.int64)
        for _, _, ends, at in trie:
            node[ends] = at
        rows = slice(*np.searchsorted(word, (lo, block.stop)))
        mine, theirs = word[rows] - lo, group[rows]
        depth, entries = b.lengths[block][mine], []
        for j in range(len(trie) + 1):
            here = np.flatnonzero(depth == j)
            here = here[np.argsort(theirs[here], kind="stable")]
            groups, starts = np.unique(theirs[here], return_index=True)
            entries.append((node[mine[here]], groups, starts))
        for p in patterns:
            p.count(trie, entries, planes, total)
    return total


def _exact(limit: int):
    """A type in which sums up to `limit` are whole numbers; products of floats are much faster."""
    return np.float32 if limit < 1 << 24 else np.float64 if limit < 1 << 53 else np.int64


def _cells(rows: DataFrame, each: str = "count(*)") -> DataFrame:
    """rows with stripe, i and j: each row (group, word, ...) is dealt to all pairs i <= j of stripes of its group that have its
    own, so it comes as often as there are stripes, not blocks. There are as many stripes as `each`, the size of a group, calls for;
    they are ranges of words, so that those of a stripe share their prefixes."""
    least, most = STRIPE
    n = F.expr(each)
    parts = F.greatest(F.least(F.ceil(n / least), F.lit(MOST_STRIPES)), F.ceil(n / most)).cast("int")
    parts = rows.groupBy("group").agg(parts.alias("parts")).agg(F.sum("parts")).first()[0] or 1
    ranged = materialise(rows.repartitionByRange(int(parts), "group", "word").withColumn("stripe", F.spark_partition_id()), "ranged")
    sizes = materialise(ranged.groupBy("group").agg(F.collect_set("stripe").alias("stripes")), "stripes")
    n = F.size("stripes").cast("long")
    cells = sizes.agg(F.sum(n * (n + 1) / 2)).first()[0] or 1
    own = ranged.join(sizes, "group").withColumn("other", F.explode("stripes"))
    own = own.withColumns({"i": F.least("stripe", "other"), "j": F.greatest("stripe", "other")}).drop("other", "stripes")
    return own.repartition(int(min(cells, MOST_TASKS)), "group", "i", "j")


def _sides(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    i, j = frame["i"].iat[0], frame["j"].iat[0]
    left = frame[frame["stripe"] == i]
    return left, left if i == j else frame[frame["stripe"] == j], i == j


#: Train words that are measured at once, and those that are measured before it is known how far a search has to look.
RING, FIRST = 512, 48
#: Stripes of the train words, and of the test words, as long as they hold no more than the most words of a stripe.
NEAR_STRIPES = 32


def _stripes(rows: DataFrame) -> int:
    n = rows.count()
    return max(1, min(-(-n // STRIPE[0]), NEAR_STRIPES), -(-n // STRIPE[1]))


def _closest(k: int):
    def work(test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        """(word, t, r, dist): for each test word the k nearest rows of a stripe of the train rows (word, r: their number by id)."""
        found = []
        if len(test) and len(train):
            a = Side(train, RING)
            b = Side(test, TEXTS, a.coded.symbols)
            number, rings = train["r"].to_numpy(np.int64)[a.order], {}
            first = max(k, FIRST)
            for at, to in b.blocks:
                own = b.coded.lengths[at:to]
                # words of about the same length, at least k rows, tell how far the k nearest may be
                mid = min(max(int(np.searchsorted(a.coded.lengths, own[len(own) // 2])) - first // 2, 0), max(len(a.words) - first, 0))
                near = np.sort(Patterns(a.coded, slice(mid, mid + first)).distances(b.coded, slice(at, to)), axis=1)
                bound = near[:, k - 1].astype(np.int64) if near.shape[1] >= k else np.full(to - at, ALL)
                row, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
                gap = [max(int(own[0] - a.coded.lengths[hi - 1]), int(a.coded.lengths[lo] - own[-1]), 0) for lo, hi in a.blocks]
                for g, (lo, hi) in sorted(zip(gap, a.blocks)):
                    if g > bound.max():
                        break
                    if lo not in rings:
                        rings[lo] = Patterns(a.coded, slice(lo, hi))
                    dist, rows = rings[lo].distances(b.coded, slice(at, to)), a.rows(lo, hi)
                    if rows.stop - rows.start > hi - lo:
                        dist = dist[:, a.at[rows] - lo]
                    r, c = np.nonzero(dist <= np.minimum(bound, np.iinfo(dist.dtype).max).astype(dist.dtype)[:, None])
                    if not len(r):
                        continue
                    row, key = np.concatenate([row, r]), np.concatenate([key, dist[r, c].astype(np.int64) << 32 | number[rows][c]])
                    order = np.lexsort((key, row))
                    row, key = row[order], key[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, key, place = (x[place < k] for x in (row, key, place))
                    last = place == k - 1
                    bound[row[last]] = np.minimum(bound[row[last]], key[last] >> 32)
                found.append(pd.DataFrame({"word": np.array(b.words[at:to], object)[row], "t": train["t"].iat[0], "r": key & 0xFFFFFFFF, "dist": key >> 32}))
        return pd.concat(found) if found else pd.DataFrame()

    return work


#: A distance beyond all.
ALL = 1 << 30


def nearest(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(id, train_id, label, dist, rank): for each test row (flow_id, word) the k nearest train rows (flow_id, label,
    word), ties by train id.

    A word of the test set is looked for once, however often it occurs; of a train word's rows the first k are enough. Stripes of test words,
    ranges that share prefixes, meet stripes of train words, sorted by length, from the nearest lengths on until none that is left can be near enough. A pair of
    stripes gives k rows for a word, and no row for the other pairs. The result is exact."""
    own = Window.partitionBy("word").orderBy("flow_id")
    few = train.where("word is not null").withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= k).drop("__n")
    few = materialise(few.select("flow_id", "label", "word"), "train")
    words = materialise(test.where("word is not null").select("word").distinct(), "words")
    sides = _stripes(words), _stripes(few)
    words = materialise(words.repartitionByRange(sides[0], "word").withColumn("s", F.spark_partition_id()), "ranged")
    stripe = F.pmod(F.xxhash64("word"), F.lit(sides[1])).cast("int")
    few = few.withColumn("t", stripe).withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy("flow_id")))
    few = materialise(few, "numbered")
    tasks = min(sides[0] * sides[1], MOST_TASKS)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = words.select("word", "s", each(sides[1]).alias("t")).repartition(tasks, "s", "t")
    b = few.select("word", "r", "t", each(sides[0]).alias("s")).repartition(tasks, "s", "t")
    near = a.groupBy("s", "t").cogroup(b.groupBy("s", "t")).applyInPandas(_closest(k), "word string, t int, r int, dist int")
    near = materialise(near, "near").withColumnRenamed("word", "test_word")
    rows = near.join(few.select("t", "r", F.col("flow_id").alias("train_id"), "label"), ["t", "r"])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("test_word").orderBy("dist", "train_id"))).where(F.col("rank") <= k)
    return test.select(F.col("flow_id").alias("id"), F.col("word").alias("test_word")).join(ranked, "test_word").select("id", "train_id", "label", "dist", "rank")


def knn(train: DataFrame, test: DataFrame, k: int, fraction: float | None = None) -> DataFrame:
    return vote(nearest(test, train, k), fraction)


def _tally(frame: pd.DataFrame) -> pd.DataFrame:
    """(label_a, label_b, dist, n) of the words of a pair of stripes."""
    left, right, same = _sides(frame)
    labels = sorted(set(frame["label"]))
    if not len(left) or not len(right):
        return pd.DataFrame()
    a = Side(left, PATTERNS)
    b = Side(right, TEXTS, a.coded.symbols, by_length=False)
    codes = {x: k for k, x in enumerate(labels)}
    own, other = ((np.array([codes[x] for x in f["label"]], np.int64), f["n"].to_numpy(np.int64)) for f in (left, right))
    far = 1 + max(int(s.coded.lengths.max(initial=0)) for s in (a, b))
    keys, sums = [], []

    def shrink():
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, place, np.concatenate(sums))
        keys[:], sums[:] = [key], [total]

    if min(len(a.words), len(b.words)) >= SLICED[0] and far - 1 <= SLICED[1] and own[1].sum() * other[1].sum() < 1 << 62:
        sides = ((s.at, c[s.order], n[s.order]) for s, (c, n) in ((a, own), (b, other)))
        total = _sliced(a.coded, b.coded, *sides, len(labels))
        q, p, d = np.nonzero(total)
        keys.append((p * len(labels) + q) * far + d)
        sums.append(total[q, p, d])
        a.blocks = []
    few = own[1].sum() * other[1].sum() < 1 << 53
    texts = [(lo, hi, *b.weights(lo, hi, *other), b.spread(lo, hi, *other)) for lo, hi in b.blocks]
    for lo, hi in a.blocks:
        patterns, (x, u), (col, p, m) = Patterns(a.coded, slice(lo, hi)), a.weights(lo, hi, *own), a.spread(lo, hi, *own)
        for at, to, y, v, (row, q, w) in texts:
            dist = patterns.distances(b.coded, slice(at, to))
            cells = len(x) * len(y) * far
            if few and cells < 1 << 16 and len(col) * len(row) <= MOST_SPREAD * dist.size:  # most words have one label: pairs are counted singly
                own_dist = dist if len(col) == hi - lo else dist[:, col]
                own_dist = own_dist if len(row) == to - at else own_dist[row]
                cell = np.add(own_dist, p * (len(y) * far), out=SCRATCH("cell", own_dist.shape, np.intp))
                cell += (q * far)[:, None]
                once = m.max() == w.max() == 1
                found = np.bincount(cell.ravel(), None if once else np.multiply.outer(w, m, out=SCRATCH("n", cell.shape, float)).ravel(), cells)
                cell = np.flatnonzero(found)
                pair, d = np.divmod(cell, far)
                keys.append((x[pair // len(y)] * len(labels) + y[pair % len(y)]) * far + d)
                sums.append(found[cell].astype(np.int64))
                continue
            inner, outer = _exact(int(u.sum())), _exact(int(u.sum()) * int(v.sum()))
            weights, turned = u.astype(inner), v.T.astype(outer)
            for d in range(int(dist.min()), int(dist.max()) + 1):
                both = (turned @ ((dist == d).astype(inner) @ weights).astype(outer)).astype(np.int64)
                r, c = np.nonzero(both)
                keys.append((x[c] * len(labels) + y[r]) * far + d)
                sums.append(both[r, c])
            if len(keys) > 20_000:
                shrink()
    shrink()
    pair, d = np.divmod(keys[0], far)
    p, q = np.divmod(pair, len(labels))
    n = sums[0]
    if same:  # every pair came both ways round, and each row with itself
        alone = np.bincount(own[0], weights=own[1], minlength=len(labels)).astype(np.int64)
        n = np.where(p == q, (n - np.where(d == 0, alone[p], 0)) // 2, n)
        p, q, d, n = (z[(p <= q) & (n > 0)] for z in (p, q, d, n))
    names_of = np.array(labels, object)
    return pd.DataFrame({"label_a": names_of[np.minimum(p, q)], "label_b": names_of[np.maximum(p, q)], "dist": d, "n": n})


def label_pairs(seqs: DataFrame, group: str | None = None) -> DataFrame:
    """(label_a, label_b, dist, n): the distances of all pairs of sequences of two labels, label_a <= label_b, each pair
    once, with how many pairs have it. Equal sequences are measured once, whatever their labels. With `group`, a column, only those of
    pairs within a group."""
    own = F.lit("") if group is None else F.col(group).cast("string")
    rows = seqs.where("label is not null and word is not null")
    w = materialise(rows.groupBy(own.alias("group"), "label", "word").agg(F.count("*").alias("n")), "words")
    found = _cells(w, "count(distinct word)").groupBy("group", "i", "j").applyInPandas(_tally, "label_a string, label_b string, dist int, n long")
    return materialise(found, "pairs").groupBy("label_a", "label_b", "dist").agg(F.sum("n").alias("n"))


def similarity_summary(pairs: DataFrame) -> DataFrame:
    p = [F.percentile("dist", q, F.col("n")).alias(name) for q, name in ((0.05, "p05"), (0.5, "median"), (0.95, "p95"))]
    return pairs.groupBy("label_a", "label_b").agg(F.min("dist").alias("min"), *p, (F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("mean"), F.max("dist").alias("max"))


def distance_matrix(pairs: DataFrame) -> DataFrame:
    """Twice the mean distance of each pair of labels, both ways round."""
    rows = pairs.groupBy("label_a", "label_b").agg((2 * F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("d"))
    return rows.unionByName(rows.where("label_a <> label_b").select(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"), "d"))


def _spread(frame: pd.DataFrame) -> pd.DataFrame:
    """(group, stripe, block, words, counts): for a block of words of a stripe, how many rows of a pair of stripes each word has at each distance;
    one of the rows has the words."""
    left, right, same = _sides(frame)
    out, group = [], frame["group"].iat[0]
    if not len(left) or not len(right):
        return pd.DataFrame()
    a = Side(left, PATTERNS)
    b = a if same else Side(right, PATTERNS, a.coded.symbols)
    n, m = (f["n"].to_numpy(np.int64)[s.order] for f, s in ((left, a), (right, b)))
    kind = _exact(int(max(n.sum(), m.sum())))
    n, m = n.astype(kind), m.astype(kind)
    far = 1 + max(int(s.coded.lengths.max(initial=0)) for s in (a, b))
    theirs = {lo: np.zeros((far, hi - lo), np.int64) for lo, hi in b.blocks} if not same else {}

    def add(stripe, side, lo, hi, counts):
        out.append((group, stripe, lo, side.words[lo:hi] if same else None, counts.tobytes()))

    for lo, hi in a.blocks:
        patterns, counts = Patterns(a.coded, slice(lo, hi)), np.zeros((far, hi - lo), np.int64)
        for at, to in b.blocks:
            dist = patterns.distances(b.coded, slice(at, to))
            for d in range(int(dist.min()), int(dist.max()) + 1):
                hit = (dist == d).astype(kind)
                counts[d] += (m[at:to] @ hit).astype(np.int64)
                if not same:
                    theirs[at][d] += (hit @ n[lo:hi]).astype(np.int64)
        add(frame["i"].iat[0], a, lo, hi, counts)
    for at, to in b.blocks if not same else ():
        add(frame["j"].iat[0], b, at, to, theirs[at])
    return pd.DataFrame(out, columns=["group", "stripe", "block", "words", "counts"])


def _least(frame: pd.DataFrame) -> pd.DataFrame:
    """(label, word, d): the word of a block with the least median distance, of equal ones the first."""
    words = list(next(w for w in frame["words"] if w is not None))
    parts = [np.frombuffer(c, np.int64).reshape(-1, len(words)) for c in frame["counts"]]
    counts = np.zeros((max(len(p) for p in parts), len(words)), np.int64)
    for p in parts:
        counts[: len(p)] += p
    upto = counts.cumsum(axis=0)
    low, high = ((upto > at).argmax(axis=0) for at in ((upto[-1] - 1) // 2, upto[-1] // 2))
    median = (low + high) / 2
    d, word = min(zip(median.tolist(), words))
    return pd.DataFrame({"label": [frame["group"].iat[0]], "word": [word], "d": [d]})


def median_sequence(seqs: DataFrame) -> DataFrame:
    """(label, word): the sequence whose median distance to all of its label, itself included, is least; ties: the first.

    Each pair of distinct words is measured once; the counts by distance of a block of words are added up over all pairs of stripes."""
    rows = seqs.where("label is not null and word is not null")
    w = materialise(rows.groupBy(F.col("label").alias("group"), "word").agg(F.count("*").alias("n")), "words")
    counts = _cells(w).groupBy("group", "i", "j").applyInPandas(_spread, "group string, stripe int, block int, words array<string>, counts binary")
    d = materialise(counts, "distances").groupBy("group", "stripe", "block").applyInPandas(_least, "label string, word string, d double")
    return materialise(d.groupBy("label").agg(F.min_by("word", F.struct("d", "word")).alias("word"), F.min("d").alias("median")), "medians")
