"""Exact dedup: frequent digests leave by a broadcast of verified winners, the rest by a shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import SHORT, cut, keep_rows, text_of

#: Counters of a Misra-Gries summary, and so the bound of the broadcast: 1,024 rows.
COUNTERS = 1024


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates (digest, low) of the frequent values of a column `digest`.

    Each task keeps `counters` counters; summaries are summed and cut back to the largest
    `counters`. A value held by more than 2/counters of all rows is always among them."""

    def summary(batches):
        held: dict = {}
        for batch in batches:
            for digest, n in batch["digest"].value_counts(sort=False).items():
                held[digest] = held.get(digest, 0) + n
            if len(held) > counters:
                floor = sorted(held.values(), reverse=True)[counters]
                held = {k: v - floor for k, v in held.items() if v > floor}
        yield pd.DataFrame({"digest": pd.Series(list(held), dtype=object), "low": pd.Series(list(held.values()), dtype="int64")})

    found = digests.select("digest").mapInPandas(summary, "digest string, low long")
    return found.groupBy("digest").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "digest").limit(counters)


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, keep_id,
    group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty texts are one group.
    The row with the largest doc_id stays. Rows that repeat a doc_id and its text each count in
    group_size and each have kept = true (they are the same row). An empty table gives no rows."""
    hashed = cut(docs.select("doc_id", F.sha2(text_of(), 256).alias("digest")), "digests")
    frequent = misra_gries(hashed, counters)
    # verified winners: exact counts of the candidates, of which there are `counters` at most
    winners = cut(
        hashed.join(F.broadcast(frequent.select("digest")), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "winners", SHORT
    )
    heavy = hashed.join(F.broadcast(winners), "digest")
    light = hashed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # a group is aggregated before its shuffle and joined back, so that no task has to hold one
    rest = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    light = light.join(rest, "digest").select(heavy.columns)
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id has; a null doc_id is the smallest.

    Each row is judged by its own text, so another text of the same doc_id stays. Of rows that repeat doc_id and text, one stays."""
    found = exact_dedup(docs)
    return keep_rows(docs, found.select("doc_id", F.unhex("text_sha256").alias("digest"), "kept"))
