"""Helpers shared by the training-data operators: lineage cuts, size-checked filters, components."""

from __future__ import annotations

import ctypes
import gc

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.sources.storage import new_table

#: A set of 8-byte ids is broadcast up to this many rows (8 MB); beyond, a shuffled join is used.
MAX_BROADCAST_IDS = 1_000_000


#: While a table is written: shuffle files go when the query has ended, as nothing reads them again, and Python workers get
#: batches of a few MB, so that neither they nor the JVM hold many texts at once.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Tables that `cut` has made and nobody has deleted yet.
_made: list[str] = []


def write(df: DataFrame, path: str, *by: str) -> None:
    spark = df.sparkSession
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that `write` has made and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A table of short rows is written by one task for so many shuffle partitions: small files burden every file system.
SHORT = 16


def cut(df: DataFrame, name: str, short: int = 1) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage and survives lost executors. `short`: the tasks
    of the last stage are put together to one for so many shuffle partitions."""
    path = new_table(df.sparkSession, name)
    write(df if short == 1 else df.coalesce(max(1, partitions(df.sparkSession) // short)), path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make, name: str) -> DataFrame:
    """`cut` for the result of make(); the tables that were cut on the way are deleted."""
    first = len(_made)
    out = cut(make(), name)
    for path in _made[first:-1]:
        remove(spark, path)
    del _made[first:-1]
    return out


def release() -> None:
    """Give a Python worker's free memory back: workers outlive the stage that used them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_of(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def map_rows(rows: DataFrame, work, columns: str) -> DataFrame:
    """mapInPandas for rows with a doc_id, which `work` hands on in its frames beside `columns`.

    Ids travel as strings: pandas makes floats of integers that stand beside nulls, and 64-bit ids would change."""
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(work, f"doc_id string, {columns}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def partitions(spark: SparkSession) -> int:
    """The session's own sizing knob: how many shuffle partitions its data needs."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest_of():
    """SHA-256 of the text, as 32 bytes."""
    return F.unhex(F.sha2(text_of(), 256))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def match_rows(docs: DataFrame, rows: DataFrame, how: str, small: bool) -> DataFrame:
    """left_semi or left_anti join of docs with rows (doc_id, digest), null ids among them."""
    key, own = fresh(docs, "__id"), fresh(docs, "__digest")
    rows = rows.select(F.col("doc_id").alias(key), F.col("digest").alias(own))
    return docs.join(F.broadcast(rows) if small else rows, F.col("doc_id").eqNullSafe(F.col(key)) & (digest_of() == F.col(own)), how)


def drop_rows(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """docs without the rows that have a doc_id and text of `rows` (doc_id, digest): broadcast if few."""
    rows = cut(rows, name, SHORT)
    return match_rows(docs, rows, "left_anti", rows.count() <= MAX_BROADCAST_IDS // 8)  # a row has 40 bytes, an id 8


def keep_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs without the rows that `marks` (doc_id, digest, kept; one row or more for each row of docs) has as kept = false.

    A row is its doc_id, null among them, and its text, so other texts of a repeated doc_id stay. Of rows that repeat both, one stays."""
    rows = marks.groupBy("doc_id", "digest").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    rows = cut(rows.select("doc_id", "digest", "kept"), "rows", SHORT)
    small = rows.count() <= MAX_BROADCAST_IDS // 8  # a row has 40 bytes, an id 8
    left = match_rows(docs, rows.where("not kept"), "left_anti", small)
    twice = rows.where("kept")
    if twice.isEmpty():
        return left
    own = fresh(docs, "__own")
    again = match_rows(left, twice, "left_semi", small).withColumn(own, digest_of()).dropDuplicates(["doc_id", own]).drop(own)
    return match_rows(left, twice, "left_anti", small).unionByName(again)


def _contract(batches):
    """Union-find over the edges of one task: as many edges as nodes at most leave it."""
    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pd.DataFrame({"a": pd.Series(nodes, dtype="int64"), "b": pd.Series([find(x) for x in nodes], dtype="int64")})


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): (node, component), component the smallest node.

    Links are first contracted within each task, then large-star and small-star steps alternate
    until nothing changes. Each step is a grouped minimum (partially aggregated before its
    shuffle) and a join; the rows never exceed the links. Nodes without links do not appear."""
    spark = links.sparkSession
    held = links.where("a <> b").mapInPandas(_contract, "a long, b long")
    edges = cut(held.repartition(max(1, partitions(spark) // SHORT)), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", SHORT)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small = cut(small, "small", SHORT)
        sizes = [d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (edges, small)]
        for path in _made[-3:-1]:  # what this round was made from
            remove(spark, path)
        del _made[-3:-1]
        edges = small
        if sizes[0] == sizes[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
