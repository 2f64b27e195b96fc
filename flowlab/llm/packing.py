"""Best-fit packing of tokenised documents into sequences by the sum of squares."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.bpe import encode_batch, tokenizer
from flowlab.llm.common import cut, release, text_of

#: Pieces that one task packs together.
BLOCK = 16384
#: Bytes of texts that are tokenised together, and parts of words that a task holds (about 30 bytes each): when there are more, those of
#: the last texts stay.
CHUNK, PARTS = 1 << 20, 100_000
NEVER = 1 << 40
#: A sequence with less than this share of room left is final after the first round.
FULL = 0.01

# Latin letters, and other visible ASCII but digits. A run of the ones and then a run of the others are exactly two words of the
# vocabulary's own splitting.
LETTERS = "".join(chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)))
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[!-/:-@\[-`{-~]*$"

#: White space that isn't ASCII, and the separators that only Python counts as white space.
WIDE_SPACE = r"[\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _gather(flat: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of `flat`, one after another, and their lengths; `lengths` cuts flat into its runs."""
    own = lengths[chosen]
    shift = (np.cumsum(lengths) - lengths)[chosen] - (np.cumsum(own) - own)
    return flat[np.repeat(shift, own) + np.arange(int(own.sum()))], own


class PartTable:
    """Ids of parts of words; a part is encoded once while it is held: `known` parts, their ids one after another, and how
    many each has.

    New letter runs are encoded together in one text: in this kind of vocabulary the last piece of a word, and no other, is
    marked as its end, which shows where to cut."""

    def __init__(self, path: str):
        self.path = path
        self.known, self.flat, self.lengths = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        own = tokenizer(path)
        self.ends = np.zeros(own.get_vocab_size(), bool)
        self.ends[[i for piece, i in own.get_vocab().items() if piece.endswith("</w>")]] = True

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = encode_batch(self.path, parts)
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(encode_batch(self.path, [" ".join(runs)])[0], "<u4")
        lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        return (ids, lengths) if len(lengths) == len(runs) and lengths.sum() == len(ids) else self._alone(runs)

    def look_up(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one after another, and how many each has."""
        at = pc.index_in(parts, self.known)
        new = parts.filter(pc.is_null(at))
        runs = pc.match_substring_regex(new, PLAIN.replace("A-Z", ""))
        plain = new.filter(runs).to_pylist()
        found = [self._together(plain[i : i + 2000]) for i in range(0, len(plain), 2000)] + [self._alone(new.filter(pc.invert(runs)).to_pylist())]
        known = pa.concat_arrays([self.known, new.filter(runs), new.filter(pc.invert(runs))])
        flat, lengths = np.concatenate([self.flat, *(f for f, _ in found)]), np.concatenate([self.lengths, *(n for _, n in found)])
        ids, own = _gather(flat, lengths, pc.index_in(parts, known).to_numpy())
        self.known, self.flat, self.lengths = (parts, ids, own) if len(known) > PARTS else (known, flat, lengths)
        return ids, own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after another, and how many each has. White space ends a word for this kind of
        vocabulary. Texts with separators that only Python counts as white space are encoded whole. Each distinct word,
        and of these each distinct part (letters, or what follows them), is looked up once."""
        odd = pc.match_substring_regex(texts, WIDE_SPACE)
        whole = {}
        if pc.any(odd).as_py():
            texts = texts.to_pylist()
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                if any(c in texts[i] for c in "\x1c\x1d\x1e\x1f"):
                    whole[i], texts[i] = np.array(encode_batch(self.path, [texts[i]])[0], "<u4"), ""
                else:
                    texts[i] = " ".join(texts[i].split())
            texts = pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(texts)  # may give empty words, which have no ids
        words = split.flatten().dictionary_encode()
        plain = pc.match_substring_regex(words.dictionary, PLAIN)
        lower = pc.utf8_lower(words.dictionary)
        heads = pc.if_else(plain, pc.utf8_rtrim(lower, SIGNS), words.dictionary).dictionary_encode()
        tails = pc.if_else(plain, pc.utf8_ltrim(lower, LETTERS), "").dictionary_encode()
        parts = pa.concat_arrays([heads.dictionary, tails.dictionary]).dictionary_encode()
        flat, lengths = self.look_up(parts.dictionary)
        at = parts.indices.to_numpy()
        both = np.stack([at[heads.indices.to_numpy()], at[len(heads.dictionary) + tails.indices.to_numpy()]], axis=1)
        flat, lengths = _gather(flat, lengths, both.ravel())
        ids, lengths = _gather(flat, lengths.reshape(-1, 2).sum(axis=1), words.indices.to_numpy())
        bounds = split.offsets.to_numpy().astype(np.int64)
        counts = np.diff(np.r_[0, np.cumsum(lengths)][bounds - bounds[0]])
        if whole:
            rows = np.split(ids, np.cumsum(counts)[:-1])
            rows = [whole.get(i, r) for i, r in enumerate(rows)]
            ids, counts = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return ids, counts


def tokenise(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pieces of every row of docs: doc_id, piece, start, length, ids_crc32, and salt, the row's number in its task. Each document's
    ids are closed by end_id; only those longer than capacity are cut."""

    def pieces(table, doc_ids, texts, row):
        ids, counts = table.encode(texts)
        ids = np.insert(ids, np.cumsum(counts), end_id)
        counts = counts + 1
        many = -(-counts // capacity)
        piece = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(np.repeat(counts, many) - start, capacity)
        begin = np.repeat(np.cumsum(counts) - counts, many) + start
        crc = [zlib.crc32(ids[a:b].data) for a, b in zip(begin.tolist(), (begin + length).tolist())]
        columns = [doc_ids.take(pa.array(np.repeat(np.arange(len(doc_ids)), many))), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.repeat(row + np.arange(len(doc_ids)), many))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    def work(batches):
        release()  # what the worker's stage before has left
        table, row = PartTable(path), 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            part = np.cumsum(pc.binary_length(texts).to_numpy()) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    yield pieces(table, doc_ids.slice(a, b - a), texts.slice(a, b - a), row + a)
            row += len(batch)
        del table
        release()

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, salt long"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given.

    Of all residual gaps with an open bin the length fits in, and a new bin, that is taken after
    which the sum over the gaps of the squared numbers of open bins is smallest; the tightest gap
    wins a tie, and filling a bin wins against leaving it open."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; gap 0 never counts
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        # taking a bin of gap g for one of gap g - size changes the sum by 2 (count[g - size] - count[g]) + 2,
        # filling one by 1 - 2 count[size], and a new bin by 2 count[capacity - size] + 1
        after = 2 * (count[0 : capacity - size + 1] - count[size : capacity + 1]) + 2
        after[0] -= 1
        after[count[size : capacity + 1] == 0] = NEVER
        gap = size + int(after.argmin())
        if after[gap - size] > (2 * count[capacity - size] + 1 if size < capacity else 0):
            used.append(0)
            b, gap = len(used) - 1, capacity
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def _pack(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Longest first, so that short pieces fill the gaps that are left; equal rows in a fixed order."""
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
    bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
    room = capacity - np.bincount(bins, weights=frame["length"], minlength=len(frame)).astype(np.int64)
    return frame.assign(sequence_id=(frame["block"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets, room=room[bins])


def pack(pieces: DataFrame, capacity: int = 4096, block: int = BLOCK) -> DataFrame:
    """pieces (doc_id, piece, length, ids_crc32, salt) with sequence_id and offset, without salt.

    Blocks of about `block` pieces, dealt by a hash of all these columns, are packed in a task each: rows without a doc_id, or that repeat
    one, even with one text, are told apart by their salt. The sequences with
    over FULL of their room left are opened again, and their pieces, a small share, are packed in
    bigger blocks of their own. Sequence numbers: the block in the upper half, odd in the second round."""
    columns, kind = pieces.columns, dict(pieces.dtypes)["doc_id"]
    kept = [c for c in columns if c != "salt"]
    count = max(1, -(-pieces.count() // block))
    pieces = pieces.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of ids beside nulls
    deal = F.xxhash64("doc_id", "piece", "ids_crc32", "length", "salt")
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", block long, sequence_id long, offset long, room long"
    first = cut(pieces.withColumn("block", 2 * F.pmod(deal, F.lit(count))).groupBy("block").applyInPandas(lambda f: _pack(f, capacity), schema), "packed")
    small = F.col("room") > int(FULL * capacity)
    rest = first.where(small).select(*columns)
    left = max(1, -(-rest.count() // block))
    second = rest.withColumn("block", 2 * F.pmod(deal, F.lit(left)) + 1).groupBy("block").applyInPandas(lambda f: _pack(f, capacity), schema)
    packed = first.where(~small).unionByName(second).withColumn("doc_id", F.col("doc_id").cast(kind))
    return packed.select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece of docs (doc_id, text; other columns are ignored): doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.

    A null or empty text has only end_id: one piece of length 1. Repeated rows are packed each. An
    empty table gives no rows."""
    return pack(cut(tokenise(docs, path, end_id, capacity), "pieces"), capacity)
