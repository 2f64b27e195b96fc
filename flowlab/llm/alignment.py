"""Cross-tokenizer alignment: tokens of two vocabularies linked through common byte offsets, and id pairs counted over the corpus
by external spill counting."""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from itertools import chain, repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.bpe import piece_bytes
from flowlab.llm.common import map_rows, new_table, partitions, release, text_of, write

#: Characters of documents whose pairs are one sorted run, and documents of a run at most.
RUN_CHARS, RUN_DOCS = 3_000_000, 50_000
#: Distinct words whose tokens a task holds, and how many new ones are encoded as one text.
WORDS, TOGETHER = 200_000, 20_000
#: Characters of the corpus for each radix part: with more data there are more parts, until each A id is one.
PART_CHARS = 16_000_000
#: Runs that are merged at once.
FAN_IN = 256

#: Where a text has to be cut with care: its first space, or a space behind white space.
ODD = re.compile(r"\A |\s ")
CUT = re.compile(r"(?<=\S)(?= )")
SPACE = re.compile(r"\s")

_loaded: dict = {}


class Aligner:
    """Tokens of distinct words under both vocabularies, with their groups and links; a word is encoded once while it is held.

    A text is cut before each space that follows a visible character: no token of either vocabulary goes over such a cut,
    so a word's tokens are the same wherever it stands, and both end there. Words are named without the space before them."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.size_b = self.b.get_piece_size()
        self.space_b = self.b.encode("a ")[len(self.b.encode("a")) :]
        self.bytes_a = piece_bytes(byte_path)
        self.bytes_b = []
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if self.b.is_byte(i) else None
            # what no text gives has no bytes, so a text that holds it has no tokens
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else b"" if self.b.is_unknown(i) or self.b.is_control(i) else piece.replace("▁", " ").encode())
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}{sign}" for i in range(max(len(self.bytes_a), self.size_b)) for sign in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.groups: list[str | None] = []  # None: the word's bytes are not those of its tokens
        self.pairs, self.times, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words_of(self, text: str) -> list[str]:
        """A text that isn't empty, cut; each word without its first space (the text's own is put before it)."""
        if ODD.search(text):
            return [w[1:] for w in CUT.split(" " + text)]
        return text.split(" ")

    def together(self, words: list[str]) -> tuple[np.ndarray, ...] | None:
        """Tokens of words without white space, encoded as one text: (ids of A, those of B, how many of A each word has, of B). None
        if the tokens don't give the words back, cut where they end."""
        text = " ".join(words)
        raw = b" " + text.encode("utf-8", "surrogatepass")
        bounds = np.cumsum(1 + np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)))
        out = []
        for ids, pieces, lengths in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.bytes_a, self.length_a), (self.b.encode(text, num_threads=1), self.bytes_b, self.length_b)):
            flat = np.array(ids, np.int64)
            ends = np.cumsum(lengths[flat])
            if b"".join(map(pieces.__getitem__, ids)) != raw or not len(ends):
                return None
            at = np.searchsorted(ends, bounds)
            if (ends[at] != bounds).any():
                return None
            out.append((flat, np.diff(at, prepend=-1)))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def alone(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The same for any words, one by one, and which of them the tokens of both give back; the others have no tokens."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        ids_b = [b if w else self.space_b for w, b in zip(words, self.b.encode(words, num_threads=1))]  # a single space at the end
        raw = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        good = [b"".join(map(self.bytes_a.__getitem__, a)) == r and b"".join(map(self.bytes_b.__getitem__, b)) == r for a, b, r in zip(ids_a, ids_b, raw)]
        empty: list = []
        ids_a, ids_b = ([x if ok else empty for x, ok in zip(ids, good)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(words)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(k.sum())) for ids, k in ((ids_a, n_a), (ids_b, n_b)))
        return flat_a, flat_b, n_a, n_b, np.array(good, bool)

    def learn(self, words: list[str]) -> None:
        """Encode words that are new: those without white space as one text for each TOGETHER of them."""
        plain, odd = [], []
        for w in words:
            (odd if not w or SPACE.search(w) else plain).append(w)
        for start in range(0, len(plain), TOGETHER):
            part = plain[start : start + TOGETHER]
            found = self.together(part)
            self._keep(part, *(found if found else self.alone(part)))
        if odd:
            self._keep(odd, *self.alone(odd))

    def _keep(self, words: list[str], flat_a: np.ndarray, flat_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, good: np.ndarray | None = None) -> None:
        n = len(words)
        # both sides of the good words have the same bytes: common ends are common in all words put together
        end_a, end_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        at = np.minimum(np.searchsorted(end_b, end_a), max(len(end_b) - 1, 0))
        ends = end_a[end_b[at] == end_a] if len(end_b) else end_a
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        word_of_a = np.repeat(np.arange(n), n_a)
        first_a = np.cumsum(in_a) - in_a
        word_of_group = word_of_a[first_a] if len(ends) else np.zeros(0, np.int64)
        links = in_a * in_b
        counts = np.stack([n_a, n_b, np.bincount(word_of_group, minlength=n), np.bincount(word_of_group, links, minlength=n).astype(np.int64)], axis=1)
        # each A token of a group with each of its B tokens
        group = np.repeat(np.arange(len(ends)), links)
        at = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        first_b = np.cumsum(in_b) - in_b
        one, other = flat_a[first_a[group] + at // in_b[group]], flat_b[first_b[group] + at % in_b[group]]
        word = word_of_group[group]
        key = one.astype(np.uint64) * np.uint64(self.size_b) + other.astype(np.uint64)
        order = np.lexsort((key, word))
        key, word = key[order], word[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (word[1:] != word[:-1])]) if len(key) else np.zeros(0, np.int64)
        self.pairs = np.concatenate([self.pairs, key[new]])
        self.times = np.concatenate([self.times, np.diff(np.r_[new, len(key)])])
        self.sizes = np.concatenate([self.sizes, np.bincount(word[new], minlength=n)])
        # tokens in order of group, side and place, each followed by the sign between it and the next
        side = np.r_[np.zeros(len(flat_a), np.int64), np.ones(len(flat_b), np.int64)]
        of = np.r_[group_a, group_b]
        order = np.argsort(2 * of + side, kind="stable")
        ids, of, side = np.r_[flat_a, flat_b][order], of[order], side[order]
        sign = np.where(of[1:] != of[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        parts = list(map(self.names.__getitem__, (3 * ids + np.r_[sign, np.full(min(1, len(ids)), 2)]).tolist()))
        stop = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(parts[begin:end])[:-1] for begin, end in zip([0, *stop], stop)]
        for i in np.flatnonzero(~good) if good is not None else ():
            self.groups[i - n] = None
        self.counts = np.concatenate([self.counts, counts])
        self.known.update(zip(words, range(len(self.known), len(self.known) + n)))

    def look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the words of some texts."""
        new = set(chain.from_iterable(texts)).difference(self.known)
        if len(self.known) + len(new) > WORDS and self.known:
            self.forget()
            new = set(chain.from_iterable(texts))
        if new:
            self.learn(sorted(new))
        return [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in texts]


def aligner(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


def _zip(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed; they are kept in as few bytes as the largest needs."""
    wide = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    planes = values.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unzip(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    return np.ascontiguousarray(raw.T).view(f"<u{blob[0]}").ravel().astype(np.int64)


RUNS = "chunk long, part int, pairs binary, counts binary, docs binary, times binary"


def run_rows(chunk: int, texts: list[np.ndarray], own: Aligner, parts: int) -> list[tuple]:
    """The sorted run of some documents, cut by the radix of the A id: the pairs as rising differences, how many documents hold
    each, those documents, and how often each holds the pair."""
    if not any(map(len, texts)):
        return []
    words = len(own.sizes)
    seen, times = np.unique(np.concatenate([i * words + x for i, x in enumerate(texts)]), return_counts=True)
    doc, word = np.divmod(seen, words)
    many = own.sizes[word]
    at = np.arange(int(many.sum())) + np.repeat((np.cumsum(own.sizes) - own.sizes)[word] - (np.cumsum(many) - many), many)
    pair, doc, times = own.pairs[at], np.repeat(doc, many), np.repeat(times, many) * own.times[at]
    radix = pair // np.uint64(own.size_b) % np.uint64(parts)
    order = np.lexsort((doc, pair, radix))
    pair, doc, times, radix = pair[order], doc[order], times[order], radix[order]
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])
    pair, doc, radix, times = pair[new], doc[new], radix[new], np.add.reduceat(times, new)
    cuts = np.r_[0, np.flatnonzero(np.diff(radix.astype(np.int64))) + 1, len(pair)].tolist()
    rows = []
    for s, e in zip(cuts[:-1], cuts[1:]):
        first = np.flatnonzero(np.r_[True, pair[s + 1 : e] != pair[s : e - 1]])
        rows.append((chunk, int(radix[s]), _zip(np.diff(pair[s:e][first], prepend=np.uint64(0))), _zip(np.diff(np.r_[first, e - s])), _zip(doc[s:e]), _zip(times[s:e])))
    return rows


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """k-way heap merge of sorted runs (pairs, counts): distinct pairs in order with the sum of their counts."""
    pairs, totals, last = [], [], -1
    for pair, count in heapq.merge(*[zip(p.tolist(), c.tolist()) for p, c in runs]):
        if pair == last:
            totals[-1] += count
        else:
            pairs.append(pair)
            totals.append(count)
            last = pair
    return np.array(pairs, np.int64), np.array(totals, np.int64)


def pair_totals(runs: DataFrame, chunks: int, size_b: int) -> DataFrame:
    """(part, pairs, totals, best): of each radix part the distinct pairs, in how many documents they are, and whether that is the most
    for their A id. Runs are merged FAN_IN at a time, in as many passes as that takes."""
    schema = "part int, run long, pairs binary, counts binary"

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        pairs, totals = merged([(np.cumsum(_unzip(p)), _unzip(c)) for p, c in zip(frame["pairs"], frame["counts"])])
        release()
        return pd.DataFrame({"part": frame["part"].iloc[:1], "run": frame["up"].iloc[:1], "pairs": [_zip(np.diff(pairs, prepend=0))], "counts": [_zip(totals)]})

    def finish(batches):
        for batch in batches:
            best = []
            for p, c in zip(batch["pairs"], batch["counts"]):
                # side-major order: the pairs of an A id stand together
                totals, own = _unzip(c), np.cumsum(_unzip(p)) // size_b
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                best.append(np.packbits(totals == np.repeat(np.maximum.reduceat(totals, first), np.diff(np.r_[first, len(own)]))).tobytes())
            yield pd.DataFrame({"part": batch["part"], "all_pairs": batch["pairs"], "totals": batch["counts"], "best": best})

    level, left = runs.select("part", F.col("chunk").alias("run"), "pairs", "counts"), chunks
    while True:
        left = -(-left // FAN_IN)
        level = level.withColumn("up", F.pmod(F.xxhash64("run"), F.lit(left)) if left > 1 else F.lit(0).cast("long"))
        level = level.groupBy("part", "up").applyInPandas(merge, schema)
        if left == 1:
            return level.mapInPandas(finish, "part int, all_pairs binary, totals binary, best binary")


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str, groups: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 and, with `groups`, groups (`a1,a2|b1;a3|b2,b3`).

    A (a byte-level BPE file) encodes a space and the text, B (a sentencepiece model) the text; special tokens' strings are plain text. Offsets where
    tokens of both end cut them into groups; all A-B pairs of a group are links. A pair's count is the number of rows that hold it linked; n_best
    counts the links whose pair has the highest count of its A id, count_sum sums the counts over the links. Texts that are null or
    empty, or that the tokens' bytes don't give back, have zeros and the empty string. Repeated rows count each. An empty table gives no rows.

    External spill counting: RUN_CHARS of documents give a run of (pair, document) records, sorted by A id and pair, cut into radix parts by the
    A id and compressed. The parts' pairs, with one number for all documents of a run, are merged by a heap; the totals and maxima go back to the
    runs, whose records add them up for their documents. A frequent pair is one entry of a run, however many documents hold it."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.char_length(text_of()))).first()[0] or 0
    parts = max(partitions(spark), 1 + size // PART_CHARS)
    path = new_table(spark, "runs")
    columns = "chunk long, part int, pairs binary, counts binary, docs binary, times binary, place int, n_a long, n_b long, n_groups long, n_links long, groups string, kind int"

    def work(batches):
        own = aligner(byte_path, piece_path)
        names = [c.split()[0] for c in columns.split(", ")]

        def emit(ids, texts, chunk):
            cut = [own.words_of(t) if t else [] for t in texts]
            numbers = own.look_up(cut)
            rows, kept = [], []
            for place, (doc_id, at) in enumerate(zip(ids, numbers)):
                found = [own.groups[i] for i in at.tolist()]
                if not found or None in found:
                    rows.append((doc_id, chunk, place, 0, 0, 0, 0, "", 0))
                    kept.append(at[:0])
                else:
                    text = ";".join(found)
                    rows.append((doc_id, chunk, place, *own.counts[at].sum(axis=0).tolist(), text if groups else hashlib.sha256(text.encode()).hexdigest(), 0))
                    kept.append(at)
            base = pd.DataFrame(rows, columns=["doc_id", "chunk", "place", "n_a", "n_b", "n_groups", "n_links", "groups", "kind"])
            runs = pd.DataFrame(run_rows(chunk, kept, own, parts), columns=["chunk", "part", "pairs", "counts", "docs", "times"]).assign(kind=1)
            for frame in (base, runs):
                yield frame.assign(**{c: None for c in names if c not in frame}, **({} if "doc_id" in frame else {"doc_id": None}))[["doc_id", *names]]

        ids, texts, size, chunk = [], [], 0, None
        for batch in batches:
            for doc_id, text, task in zip(batch["doc_id"], batch["text"], batch["task"].tolist()):
                chunk = task << 32 if chunk is None else chunk
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= RUN_CHARS or len(ids) >= RUN_DOCS:
                    yield from emit(ids, texts, chunk)
                    ids, texts, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield from emit(ids, texts, chunk)
        del ids, texts
        own.forget()
        release()

    rows = docs.select("doc_id", text_of().alias("text"), F.spark_partition_id().cast("long").alias("task"))
    write(map_rows(rows, work, columns), path, "kind")
    kind = dict(docs.dtypes)["doc_id"]
    table = spark.read.schema(f"doc_id {kind}, {columns}").parquet(path)
    base, runs = table.where("kind = 0"), table.where("kind = 1").select("chunk", "part", "pairs", "counts", "docs", "times")
    size_b = len(aligner(byte_path, piece_path).bytes_b)
    totals = pair_totals(runs, max(1, base.select("chunk").distinct().count()), size_b)

    def contribute(batches):
        """(chunk, places, best, sums): what the pairs of a radix part give to the documents of a run."""
        for batch in batches:
            out = []
            for r in batch.itertuples():
                have = np.cumsum(_unzip(r.all_pairs))
                at = np.searchsorted(have, np.cumsum(_unzip(r.pairs)))
                counts = _unzip(r.counts)
                total, best = np.repeat(_unzip(r.totals)[at], counts), np.repeat(np.unpackbits(np.frombuffer(r.best, np.uint8))[at], counts)
                doc, times = _unzip(r.docs), _unzip(r.times)
                sums = np.zeros((2, int(doc.max()) + 1), np.int64)
                np.add.at(sums[0], doc, best * times)
                np.add.at(sums[1], doc, total * times)
                held = np.flatnonzero(sums[1])
                out.append((r.chunk, _zip(held), _zip(sums[0][held]), _zip(sums[1][held])))
            yield pd.DataFrame(out, columns=["own", "places", "best", "sums"])
        release()

    gained = runs.join(totals, "part").select("chunk", "pairs", "counts", "docs", "times", "all_pairs", "totals", "best").mapInPandas(contribute, "own long, places binary, best binary, sums binary")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((2, int(left["place"].max()) + 1), np.int64)
        for places, best, total in zip(right["places"], right["best"], right["sums"]):
            at = _unzip(places)
            sums[0][at] += _unzip(best)
            sums[1][at] += _unzip(total)
        place = left["place"].to_numpy()
        return left.assign(n_best=sums[0][place], count_sum=sums[1][place])[names]

    base = base.withColumn("doc_id", F.col("doc_id").cast("string")).select("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    out = base.groupBy("chunk").cogroup(gained.groupBy("own")).applyInPandas(finish, "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)) if groups else F.col("groups")
    out = out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("groups_sha256", digest)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups)
