"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import MAX_BROADCAST_IDS, SHORT, cut, map_rows, release, text_of

NGRAMS = (4, 5, 6)
BITS = 18
#: Labelled rows of each class the linear classifier is fitted on at most, whole, taken by a hash of
#: doc_id: the default of the parameter `sample`. The log-count ratios are counted over all labelled rows.
SAMPLE = 1500
PENALTY = 2e-3
#: Ratios less than so many standard errors from 0 count as 0: in long texts their sum would be noise. Chosen, with PENALTY, by
#: two folds inside the training rows (best AUC, 0.989).
CERTAIN = 2.5
#: Parts in which the counts of all tasks are summed, and groups of tasks that are summed first.
CHUNKS, SALTS = 32, 256


def ngram_buckets(text: str) -> np.ndarray:
    """Distinct buckets of the character n-grams (in bytes) of a lower-cased text; any run of
    other characters than letters and digits counts as one space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    word = (raw >= 128) | (raw >= 97) & (raw <= 122) | (raw >= 48) & (raw <= 57)
    raw = np.where(word, raw, 32).astype(np.uint32)
    raw = raw[np.r_[True, word[1:] | word[:-1]]]
    found = []
    for n in NGRAMS:
        if len(raw) >= n:
            value = np.full(len(raw) - n + 1, n, np.uint32)
            for k in range(n):
                value = value * np.uint32(0x01000193) + raw[k : len(raw) - n + 1 + k]
            value *= np.uint32(0x9E3779B1)
            found.append((value >> np.uint32(32 - BITS)).astype(np.int64))
    if not found:
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << BITS, bool)
    seen[np.concatenate(found)] = True
    return np.flatnonzero(seen)


def count_ngrams(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents with each bucket, by label 1 and 0, and documents by label, over all rows (text, label).

    Each task sums its rows to one array, of fixed size, cut in CHUNKS; the chunks are summed in two shuffles, so
    that no group holds a chunk of every task. What reaches the driver has the size of two arrays, whatever the corpus."""
    size = (1 << BITS) // CHUNKS

    def part(batches):
        total, docs = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                total[int(label), ngram_buckets(text)] += 1
                docs[int(label)] += 1
        if docs.sum():
            yield pd.DataFrame({"chunk": range(CHUNKS), "n0": int(docs[0]), "n1": int(docs[1]), "counts": [_pack(total[:, c * size : (c + 1) * size]) for c in range(CHUNKS)]})
        del total
        release()

    def add(frame):
        total = np.zeros(2 * size, np.int64)
        for b in frame["counts"]:
            total += _unpack(b)
        return pd.DataFrame({"chunk": [frame["chunk"].iat[0]], "n0": [frame["n0"].sum()], "n1": [frame["n1"].sum()], "counts": [_pack(total)]})

    schema = "chunk int, n0 long, n1 long, counts binary"
    parts = labelled.select("text", "label").mapInPandas(part, schema).withColumn("salt", F.spark_partition_id() % SALTS)
    rows = parts.groupBy("chunk", "salt").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    if not rows:
        return np.zeros(1 << BITS), np.zeros(1 << BITS), 0, 0
    total = np.concatenate([_unpack(r["counts"]).reshape(2, size) for r in sorted(rows, key=lambda r: r["chunk"])], axis=1)
    return total[1], total[0], rows[0]["n1"], rows[0]["n0"]


def _pack(counts: np.ndarray) -> bytes:
    """Counts, nearly all small, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.int64).ravel()


def _minimise(loss_and_slope, x: np.ndarray, steps: int = 50, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with a halving line search."""
    value, slope = loss_and_slope(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(moves):
            a = s @ way / (y @ s)
            kept.append(a)
            way -= a * y
        if moves:
            way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1])
        for (s, y), a in zip(moves, reversed(kept)):
            way += (a - y @ way / (y @ s)) * s
        step, drop = 1.0 if moves else 1 / max(1.0, float(np.abs(slope).sum())), slope @ way
        while step > 1e-9:
            new = x - step * way
            new_value, new_slope = loss_and_slope(new)
            if new_value <= value - 1e-4 * step * drop:
                break
            step /= 2
        else:
            break
        if (new_slope - slope) @ (new - x) > 1e-12:
            moves = [*moves, (new - x, new_slope - slope)][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def log_ratios(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket: ln of its smoothed share among the documents of label 1 over that of label 0;
    0 where it isn't certain."""
    ratio = np.log((ones + 1) / (n1 + 2)) - np.log((zeros + 1) / (n0 + 2))
    ratio[np.abs(ratio) < CERTAIN * np.sqrt(1 / (ones + 1) + 1 / (zeros + 1))] = 0
    return ratio


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(weights per bucket, intercept) from rows (doc_id, text, label 0 or 1).

    Without rows of both labels no classifier can be fitted: the weights are zero and the intercept
    is the log odds of the labels, each counted once more than it occurs. The classifier is fitted on at most `sample`
    documents of each label: ids are ranked without the texts, and those of the chosen are turned to buckets where they are."""
    ones, zeros, n1, n0 = count_ngrams(labelled)
    if not n1 or not n0:
        return np.zeros(1 << BITS, np.float32), float(np.log((n1 + 1) / (n0 + 1)))
    ratio = log_ratios(ones, zeros, n1, n0)
    ids = labelled.select("doc_id", "label").distinct()
    chosen = [ids.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = cut(chosen[0].unionByName(chosen[1]), "sample", SHORT)  # 2 * sample ids
    texts = labelled.join(F.broadcast(chosen), ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def buckets(batches):
        for batch in batches:
            own = [ngram_buckets(t) for t in batch["text"]]
            yield pd.DataFrame({"order": batch["order"], "label": batch["label"], "ids": [x[ratio[x] != 0].astype(np.int32).tobytes() for x in own]})

    rows = texts.select(F.xxhash64("doc_id").alias("order"), "label", "text").mapInPandas(buckets, "order long, label int, ids binary")

    def train(batches):
        rows = pd.concat(list(batches)).sort_values(["order", "label"], kind="stable")
        ids = [np.frombuffer(b, np.int32) for b in rows["ids"]]
        column = np.concatenate(ids)
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        r, y = ratio[column], rows["label"].to_numpy() * 2.0 - 1
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

        def loss(x):
            z = y * (np.bincount(row, r * x[column], len(y)) + x[-1])
            pull = -y * share / (1 + np.exp(np.clip(z, -500, 500)))
            slope = np.r_[np.bincount(column, r * pull[row], 1 << BITS), pull.sum()]
            slope[:-1] += PENALTY * x[:-1]
            return float((share * np.logaddexp(0, -z)).sum() + PENALTY / 2 * (x[:-1] @ x[:-1])), slope

        x = _minimise(loss, np.zeros((1 << BITS) + 1))
        # both labels count alike, however many rows they have
        yield pd.DataFrame({"weights": [(x[:-1] * ratio).astype(np.float32).tobytes()], "intercept": [float(x[-1])]})

    model = rows.repartition(1).mapInPandas(train, "weights binary, intercept double").first()
    return np.frombuffer(model["weights"], np.float32), model["intercept"]


def labelled_documents(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """(doc_id, text, label) of the documents that may be learned from: labelled, and not held out."""
    known = labels.where(F.col("toxic").cast("int").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).where(~held_out(fold))
    known = cut(known, "labels", SHORT)
    small = known.count() <= MAX_BROADCAST_IDS
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known) if small else known, "doc_id")


def held_out(fold: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == rest, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, held_out, score, predicted.

    Labels (doc_id, toxic) of held out rows are not learned from; of repeated labels the largest counts; null
    labels, and others than 0 and 1, are none. A null or empty text has no n-gram and the intercept's score; a score of exactly 0.5 counts as label 1. Repeated
    rows repeat. An empty table gives no rows."""
    weights, intercept = fit(labelled_documents(docs, labels, fold), sample)
    shared = docs.sparkSession.sparkContext.broadcast((weights, intercept))  # 2^BITS floats: 1 MB

    def work(batches):
        own, start = shared.value
        for batch in batches:
            total = np.array([start + float(own[ngram_buckets(t)].sum(dtype=np.float64)) for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": 1 / (1 + np.exp(-np.clip(total, -500, 500)))})
        release()

    rows = docs.select("doc_id", text_of().alias("text"), held_out(fold).alias("held_out"))
    scored = map_rows(rows, work, "held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
