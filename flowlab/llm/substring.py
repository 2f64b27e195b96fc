"""Substring dedup with a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import map_rows, new_table, partitions, release, remove, text_of, write

#: Words a task hashes and sorts at once (a longer text alone is one such part).
CHUNK = 200_000
#: Runs that are merged to one when so many have gathered.
FAN_IN = 3
#: Windows of a batch that one bucket is to hold, and characters whose hits one group is to hold: with more data there are
#: more buckets and groups, so that their memory stays.
BUCKET_WINDOWS, SLOT_CHARS = 1 << 18, 8_000_000
#: Windows in a row of the index.
ROW = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, 13)
        return value


def window_hashes(texts: list[list[bytes]], width: int):
    """(text, place, key, check) of each window of `width` words within a text: its number, the window's first word, and two
    hashes by independent multipliers, of 64 and 16 bits."""
    sizes = np.array([len(t) for t in texts], np.int64)
    one = np.fromiter(map(_Hashes().__getitem__, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
    n = max(0, len(one) - width + 1)
    key, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    odd = np.random.default_rng(2024).integers(1, 1 << 62, (2, width), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    high = one >> np.uint64(32) ^ one * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        key += one[k : k + n] * odd[0, k]
        check += high[k : k + n] * odd[1, k]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    place = np.arange(len(one), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.flatnonzero(text[:n] == text[width - 1 :]) if n else np.zeros(0, np.int64)
    return text[inside], place[inside].astype(np.uint32), key[inside], (check[inside] >> np.uint64(48)).astype(np.uint16)


def _planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte plane by byte plane, compressed: about 5 bytes each."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _values(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def _index_rows(bucket: int, keys: np.ndarray, checks: np.ndarray) -> pd.DataFrame:
    starts = range(0, len(keys), ROW)
    return pd.DataFrame({"bucket": pd.Series([bucket] * len(starts), dtype="int32"), "keys": pd.Series([_planes(keys[s : s + ROW]) for s in starts], dtype=object), "checks": pd.Series([checks[s : s + ROW].tobytes() for s in starts], dtype=object)})


def _first(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where a sorted (key, check) differs from the one before."""
    return np.r_[True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])] if len(keys) else np.zeros(0, bool)


def _repeated(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which of some windows, sorted by key, also start in a smaller document among them."""
    out = np.zeros(len(keys), bool)
    same = keys[1:] == keys[:-1]
    rows = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    if len(rows):
        rows = rows[np.lexsort((docs[rows], checks[rows], keys[rows]))]
        first = _first(keys[rows], checks[rows])
        out[rows] = docs[rows] > docs[rows][first][np.cumsum(first) - 1]
    return out


INDEX = "bucket int, keys binary, checks binary"
HITS = "kind int, slot long, a binary, b binary, c binary"


def _hit_rows(docs: np.ndarray, places: np.ndarray, slots: int) -> list[tuple]:
    """Rows (0, slot, distinct documents, how many places each, places) of hits."""
    if not len(docs):
        return []
    slot = docs % slots
    order = np.lexsort((places, docs, slot))
    docs, places, slot = docs[order], places[order], slot[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, len(slot)].tolist()
    rows = []
    for s, e in zip(cuts[:-1], cuts[1:]):
        own, counts = np.unique(docs[s:e], return_counts=True)
        rows.append((0, int(slot[s]), own.tobytes(), counts.astype("<u4").tobytes(), places[s:e].astype("<u4").tobytes()))
    return rows


class WindowIndex:
    """Historical windows of `width` words as sorted, immutable runs; batches come in rising doc_id order.

    hits of a batch are those of its windows that also start in a document with a smaller doc_id, in
    the history or in the batch itself; add(batch) finds them and makes the batch a run. A run is a written
    table with the sorted fingerprints of a bucket in each row (a range of keys). A batch is dealt
    to the same buckets, sorted, and merge-joined with the runs by binary search; a found key counts if its
    check, an independent hash of the same words, agrees too (80 bits in all). FAN_IN runs
    are merged to one without repeats. Fingerprints alone stay in the index: that a window is in the
    history says that an earlier document has it.

    A task first compares the windows it holds itself: of a passage that many of its documents share only the
    smallest document's goes to the bucket, so that a bucket gets a frequent window once or so from each part of CHUNK words."""

    def __init__(self, spark: SparkSession, width: int = 13, buckets: int | None = None, slots: int = 1):
        self.spark, self.width, self.slots = spark, width, slots
        self.bits = max(6, (max(partitions(spark), buckets or 1) - 1).bit_length())
        self.runs: list[str] = []

    def windows(self, batch: DataFrame) -> DataFrame:
        """Blobs of a batch's windows: bucket, base (smallest doc_id), n, and arrays sorted by key. Buckets from
        2^bits on have the windows that are hits already."""
        width, shift, buckets = self.width, np.uint64(64 - self.bits), 1 << self.bits

        def blob(bucket, keys, checks, docs, places):
            base = int(docs.min())
            wide = "<u4" if int(docs.max()) - base < 1 << 32 else "<u8"
            long = "<u2" if int(places.max()) < 1 << 16 else "<u4"
            return int(bucket), base, len(docs), keys.tobytes(), checks.tobytes(), (docs - base).astype(wide).tobytes(), places.astype(long).tobytes()

        def emit(texts, ids):
            text, place, key, check = window_hashes(texts, width)
            order = np.argsort(key, kind="stable")
            doc, place, key, check = np.array(ids, np.int64)[text[order]], place[order], key[order], check[order]
            known = _repeated(key, check, doc)
            rows = []
            if known.any():
                hit_doc, hit_place = doc[known], place[known]
                to = buckets + hit_doc % buckets
                by = np.argsort(to, kind="stable")
                cuts = np.r_[0, np.flatnonzero(np.diff(to[by])) + 1, len(by)].tolist()
                rows += [blob(to[by[s]], key[:0], check[:0], hit_doc[by[s:e]], hit_place[by[s:e]]) for s, e in zip(cuts[:-1], cuts[1:])]
                doc, place, key, check = doc[~known], place[~known], key[~known], check[~known]
            if len(key):
                bucket = (key >> shift).astype(np.int64)
                cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)].tolist()
                rows += [blob(bucket[s], key[s:e], check[s:e], doc[s:e], place[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
            return pd.DataFrame(rows, columns=["bucket", "base", "n", "keys", "checks", "docs", "places"])

        def work(batches):
            ids, texts, size = [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                    words = text.encode("utf-8", "surrogatepass").split()
                    if len(words) >= width:
                        ids.append(doc_id)
                        texts.append(words)
                        size += len(words)
                    if size >= CHUNK:
                        yield emit(texts, ids)
                        ids, texts, size = [], [], 0
            if ids:
                yield emit(texts, ids)
            del ids, texts
            release()

        rows = batch.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        return rows.mapInPandas(work, "bucket int, base long, n int, keys binary, checks binary, docs binary, places binary")

    @staticmethod
    def _columns(frame: pd.DataFrame):
        keys = np.frombuffer(b"".join(frame["keys"]), np.uint64)
        checks = np.frombuffer(b"".join(frame["checks"]), np.uint16)
        docs = np.concatenate([np.frombuffer(b, "<u8" if len(b) == 8 * n else "<u4").astype(np.int64) + base for b, n, base in zip(frame["docs"], frame["n"], frame["base"])])
        places = np.concatenate([np.frombuffer(b, "<u4" if len(b) == 4 * n else "<u2").astype(np.uint32) for b, n in zip(frame["places"], frame["n"])])
        return keys, checks, docs, places

    def _history(self) -> DataFrame:
        out = self.spark.createDataFrame([], INDEX)
        for path in self.runs:
            out = out.unionByName(self.spark.read.schema(INDEX).parquet(path))
        return out

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """The hits of a batch: (slot, docs, counts, places), slot = doc_id mod slots. The batch becomes a run,
        unless it is the last that will come."""
        columns, slots, buckets = self._columns, self.slots, 1 << self.bits

        def merge(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            rows: list[tuple] = []
            if len(new):
                bucket = int(new["bucket"].iat[0])
                keys, checks, docs, places = columns(new)
                if bucket >= buckets:
                    rows = _hit_rows(docs, places, slots)
                else:
                    order = np.lexsort((docs, checks, keys))
                    keys, checks, docs, places = keys[order], checks[order], docs[order], places[order]
                    first = _first(keys, checks)
                    group = np.cumsum(first) - 1
                    one = np.flatnonzero(first)
                    own_keys, own_checks = keys[one], checks[one]
                    known = np.zeros(len(one), bool)
                    # merge join with each sorted row of the runs: nearly always one entry has the key, or none
                    for blob, marks in zip(old["keys"], old["checks"]):
                        have, have_checks = _values(blob), np.frombuffer(marks, np.uint16)
                        at = np.searchsorted(have, own_keys)
                        live = np.flatnonzero(at < len(have))
                        while len(live):
                            live = live[have[at[live]] == own_keys[live]]
                            known[live] |= have_checks[at[live]] == own_checks[live]
                            at[live] += 1
                            live = live[at[live] < len(have)]
                    hit = known[group] | (docs > docs[first][group])  # docs are sorted within a window's group
                    rows = _hit_rows(docs[hit], places[hit], slots)
                    if not last:
                        fresh = ~known
                        rows += [(1, r.bucket, r.keys, r.checks, b"") for r in _index_rows(bucket, own_keys[fresh], own_checks[fresh]).itertuples()]
            return pd.DataFrame(rows, columns=["kind", "slot", "a", "b", "c"])

        path = new_table(self.spark, "windows")
        write(self.windows(batch).groupBy("bucket").cogroup(self._history().groupBy("bucket")).applyInPandas(merge, HITS), path, "kind")
        out = self.spark.read.schema(HITS).parquet(path)
        if not last:
            run = new_table(self.spark, "run")
            write(out.where("kind = 1").select(F.col("slot").cast("int").alias("bucket"), F.col("a").alias("keys"), F.col("b").alias("checks")), run)
            remove(self.spark, f"{path}/kind=1")
            self.runs.append(run)
            if len(self.runs) >= FAN_IN:
                self.compact()
        return out.where("kind = 0").select("slot", F.col("a").alias("docs"), F.col("b").alias("counts"), F.col("c").alias("places"))

    def compact(self) -> None:
        """Merge all runs to one sorted run without repeats."""

        def merged(frame: pd.DataFrame) -> pd.DataFrame:
            keys, checks = np.concatenate([_values(b) for b in frame["keys"]]), np.frombuffer(b"".join(frame["checks"]), np.uint16)
            order = np.lexsort((checks, keys))
            keys, checks = keys[order], checks[order]
            keep = _first(keys, checks)
            return _index_rows(int(frame["bucket"].iat[0]), keys[keep], checks[keep])

        path = new_table(self.spark, "run")
        write(self._history().groupBy("bucket").applyInPandas(merged, INDEX), path)
        self.drop()
        self.runs = [path]

    def drop(self) -> None:
        """Delete the index."""
        for path in self.runs:
            remove(self.spark, path)
        self.runs = []


def batches_of(docs: DataFrame, count: int) -> tuple[list[DataFrame], int]:
    """docs in `count` batches of rising doc_id, of about equal numbers of rows; and the characters of all texts."""
    # the bounds may be off by rounding; whatever they are, each row with an id is in one batch
    bounds = F.percentile_approx(F.col("doc_id").cast("long"), [i / count for i in range(1, count)] or [0.5], 1000)
    found = docs.agg(bounds.alias("bounds"), F.sum(F.char_length(text_of())).alias("size")).first()
    key = F.col("doc_id").cast("long")
    out, low = [], None
    for high in [*(sorted(set(found["bounds"] or [])) if count > 1 else []), None]:
        rows = docs if low is None else docs.where(key > low)
        out.append(rows if high is None else rows.where(key <= high))
        low = high
    return out, found["size"] or 0


def _intervals(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """(doc_id, gone) of a group of hits: the removed words as rising first words and ends, 32 bits each."""
    docs = np.repeat(np.frombuffer(b"".join(frame["docs"]), np.int64), np.frombuffer(b"".join(frame["counts"]), "<u4"))
    places = np.frombuffer(b"".join(frame["places"]), "<u4").astype(np.int64)
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + width)]
    at = np.flatnonzero(new)
    ends = places[np.r_[at[1:], len(places)] - 1] + width
    spans = np.stack([places[at], ends], axis=1).astype("<u4")
    own, first = np.unique(docs[at], return_index=True)
    return pd.DataFrame({"doc_id": own, "gone": pd.Series([spans[s:e].tobytes() for s, e in zip(first, np.r_[first[1:], len(spans)])], dtype=object)})


def substring_dedup(docs: DataFrame, width: int = 13, batches: int = 4, texts: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, an integer, and text; other columns are ignored): doc_id, n_words,
    n_removed, kept_sha256 and, with `texts`, text (the kept words joined by a space).

    Every word is removed that is covered by a window of `width` words which also starts in a document
    with a smaller doc_id, judged on the input. A null text has no words. A doc_id names one
    document: rows that repeat it with the same text have the same result; with another text,
    places removed in one are removed in all. A null doc_id is no document: its row keeps all
    words. An empty table gives no rows."""
    spark = docs.sparkSession
    parts, size = batches_of(docs, batches)
    index = WindowIndex(spark, width, -(-size // 6 // batches // BUCKET_WINDOWS), 1 + size // SLOT_CHARS)
    hits = [index.add(part, last=i == len(parts) - 1) for i, part in enumerate(parts)]
    index.drop()
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    gone = found.groupBy("slot").applyInPandas(lambda frame: _intervals(frame, width), "doc_id long, gone binary")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 5 if texts else 4]

    def work(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, spans in zip(batch["doc_id"].tolist(), batch["text"], batch["gone"]):
                words = text.encode("utf-8", "surrogatepass").split()
                left = words
                if spans is not None:
                    left, at = [], 0
                    for begin, end in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
                        left += words[at:begin]
                        at = end
                    left += words[at:]
                kept = b" ".join(left)
                row = (doc_id, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode("utf-8", "surrogatepass")) if texts else row)
                size += len(text)
                if size > 1 << 22:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)
        release()

    rows = docs.select("doc_id", text_of().alias("text")).join(gone.withColumnRenamed("doc_id", "__id"), F.col("doc_id").cast("long") == F.col("__id"), "left")
    return map_rows(rows.select("doc_id", "text", "gone"), work, "n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)
