"""Ranked lexical search of many items over all documents, with documents of one bag scored once."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import cut, map_rows, release, text_of

#: Items, and characters of items, that are searched together: more items make more blocks, each a pass over the documents.
ITEMS, ITEM_CHARS = 5_000, 20_000_000
#: Scores (classes times items) that a task holds at once.
SCORES = 2_000_000
#: Parts into which a class is dealt before its members meet, so that none of many members is gathered in one task.
SALTS = 32

#: Every byte that no term holds becomes a space, A-Z become a-z; bytes from 128 on are parts of letters outside ASCII.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order: maximal runs of ASCII letters, digits and characters outside ASCII; A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


class ItemBlock:
    """Some items: their terms as numbers, and for each term the items that hold it and how often."""

    def __init__(self, texts: dict):
        bags = {i: Counter(t for text in own for t in terms_of(text or "")) for i, own in texts.items()}
        self.items = [i for i, bag in bags.items() if bag]
        self.vocabulary = {t: n for n, t in enumerate(sorted(set().union(*bags.values())))}
        rows = sorted((self.vocabulary[t], place, times) for place, i in enumerate(self.items) for t, times in bags[i].items())
        term, self.place, self.times = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        self.first = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))


def bags_of(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """(doc_id, n, digest long, bag binary) of every row of docs: its number of terms, and those in the vocabulary with how often
    they occur: rising numbers, then the counts, 32 bits each."""

    def work(batches):
        for batch in batches:
            ns, bags = [], []
            for text in batch["text"]:
                terms = terms_of(text)
                own, counts = np.unique(np.fromiter((vocabulary[t] for t in terms if t in vocabulary), "<u4"), return_counts=True)
                ns.append(len(terms))
                bags.append(own.tobytes() + counts.astype("<u4").tobytes())
            digest = np.array([xxhash.xxh64_intdigest(b) for b in bags], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": np.array(ns, np.int64), "digest": digest, "bag": bags})
        release()

    return map_rows(docs.select("doc_id", text_of().alias("text")), work, "n long, digest long, bag binary")


def document_frequencies(bags: DataFrame, terms: int) -> np.ndarray:
    """How many rows hold each term; one sum for each task and term leaves the tasks."""

    def work(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            flat = b"".join(b[: len(b) // 2] for b in batch["bag"])
            total += np.bincount(np.frombuffer(flat, "<u4"), minlength=terms)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held.astype(np.int32), "df": total[held]})

    found = bags.select("bag").mapInPandas(work, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(terms, np.int64)
    for r in found.collect():  # as many rows as a block of items has terms
        out[r.term] = r.df
    return out


def classes_of(bags: DataFrame, documents: int, terms: int, top: int) -> DataFrame:
    """(bag, m, ids array) of the classes of rows with one bag and one m; ids: the class's `top` smallest doc_ids (null ones
    last), as no search shows more of them. Rows meet by the digest of their bag, and are told apart by the bag itself.

    A class's rows are first dealt into SALTS parts with `top` rows left of each, so one of any size is spread over tasks."""
    m = (F.lit(25) + F.expr(f"(75 * n * {documents}L) div {max(terms, 1)}L")).alias("m")
    key, order = ["digest", "m", "bag"], F.col("doc_id").asc_nulls_last()
    rows = bags.where("length(bag) > 0").select("doc_id", m, "digest", "bag", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "salt").orderBy(order))).where(f"rank <= {top}")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(f"rank <= {top}")
    # at most `top` rows of a class are left
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("doc_id").alias("row")))), lambda x: x["row"]["doc_id"])
    return rows.groupBy(*key).agg(ids.alias("ids")).select("bag", "m", "ids")


def best_of(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """The `top` rows of each item by falling score, then by doc_id, null ones last."""
    rows = rows.sort_values(["item", "score", "none", "doc"], ascending=[True, False, True, True], ignore_index=True)
    return rows[rows.groupby("item").cumcount() < top]


def score_classes(classes: DataFrame, block: ItemBlock, weights: np.ndarray, top: int) -> DataFrame:
    """(item int, score long, doc_id long): the best `top` documents of each item in each task. A class is scored once."""

    def score(bags: list[bytes], m: np.ndarray) -> np.ndarray:
        size = np.array([len(b) // 8 for b in bags], np.int64)
        term = np.frombuffer(b"".join(b[: len(b) // 2] for b in bags), "<u4").astype(np.int64)
        tf = np.frombuffer(b"".join(b[len(b) // 2 :] for b in bags), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(bags)), size)
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        many = block.first[term + 1] - block.first[term]
        at = np.repeat(block.first[term] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out = np.zeros(len(bags) * len(block.items), np.int64)
        np.add.at(out, np.repeat(row * len(block.items), many) + block.place[at], np.repeat(part, many) * block.times[at])
        return out.reshape(len(bags), -1)

    def work(batches):
        best, step = pd.DataFrame({"item": [], "score": [], "none": [], "doc": []}, dtype="int64"), max(1, SCORES // len(block.items))
        for batch in batches:
            first = [ids[0] for ids in batch["ids"]]
            order = sorted(range(len(first)), key=lambda i: (first[i] is None, first[i] or 0))
            for start in range(0, len(order), step):
                own = batch.iloc[order[start : start + step]]
                scores = score(own["bag"].tolist(), own["m"].to_numpy(np.int64))
                # classes stand in order of their smallest doc_id: of equal scores the first `top` are enough
                rank = np.argsort(-scores, axis=0, kind="stable")[:top]
                value = np.take_along_axis(scores, rank, axis=0)
                place, item = np.nonzero(value > 0)
                chosen, ids = rank[place, item], own["ids"].tolist()
                lists = [ids[c] for c in chosen.tolist()]
                many = [len(x) for x in lists]
                flat = [d for x in lists for d in x]
                new = pd.DataFrame({"item": np.repeat(item, many), "score": np.repeat(value[place, item], many), "none": np.array([d is None for d in flat], np.int64), "doc": np.array([d or 0 for d in flat], np.int64)})
                best = best_of(pd.concat([best, new], ignore_index=True), top)
        doc = best["doc"].astype("Int64").mask(best["none"] == 1)
        yield pd.DataFrame({"item": best["item"].astype("int32"), "score": best["score"], "doc_id": doc})
        release()

    # 64-bit ids stay exact: lists of Python numbers come in, a nullable column goes out
    typed = classes.select("bag", "m", F.transform("ids", lambda x: x.cast("string")).alias("ids"))

    def exact(batches):
        def numbers(batches):
            for batch in batches:
                yield batch.assign(ids=[[None if d is None else int(d) for d in ids] for ids in batch["ids"]])

        return work(numbers(batches))

    return typed.mapInPandas(exact, "item int, score long, doc_id long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """For each item (item_id, text) the `top` documents (doc_id, an integer, and text; other columns are ignored) with the
    highest scores above 0: item_id, rank (from 1), doc_id, score; equal scores by doc_id, null ones last.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's m is 25 + (75 n N) div L; a score sums weight *
    ((10^9 tf) div (1000 tf + 8 m)) over the item's terms. Rows that repeat an item_id are one item with the terms of all of
    them; a null text has no terms, and an item without terms no rows. Repeated rows of docs are documents of their own. An empty table gives
    no rows. Items are searched in blocks of at most ITEMS items (or ITEM_CHARS characters, by the mean)."""
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    size = items.agg(F.count("*").alias("n"), F.sum(F.char_length(text_of())).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-(size["chars"] or 0) // ITEM_CHARS))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number in range(blocks):
        texts: dict = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).select("item_id", "text").collect():
            texts.setdefault(r.item_id, []).append(r.text)
        block = ItemBlock(texts)
        if block.items:
            out = out.unionByName(_search(docs, block, kind, top))
    return out


def _search(docs: DataFrame, block: ItemBlock, kind: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    bags = cut(bags_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block.vocabulary), "bags")
    total = bags.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("terms")).first()
    frequencies = document_frequencies(bags, len(block.vocabulary)).tolist()
    weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * df + 1))) for df in frequencies], np.int64)
    found = score_classes(classes_of(bags, total["n"], total["terms"] or 0, top), block, weights, top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}")
    names = spark.createDataFrame([(n, i) for n, i in enumerate(block.items)], f"item int, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
