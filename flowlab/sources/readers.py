"""Readers of captures, catalogues and results. Schemas are explicit: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab import schema

CATALOG = ("companies", "tags", "tag_assignment", "traces_metadata", "urls", "jobs")


def read_catalog(spark: SparkSession, options: dict) -> dict[str, DataFrame]:
    """The catalogue's tables, by JDBC (options url, and driver, user, ... at run time) or from parquet (option path).
    Column choice and filters are pushed to the source."""
    if "path" in options:
        return {t: spark.read.parquet(f"{options['path']}/{t}") for t in CATALOG}
    return {t: spark.read.format("jdbc").options(**options, dbtable=t).load() for t in CATALOG}


def read_packets(spark: SparkSession, path: str, sep: str = ",", columns: str = schema.PACKET) -> DataFrame:
    """Packet rows of CSV files with a header; bad lines are left out (rows whose frame number doesn't parse)."""
    rows = spark.read.schema(columns).option("columnPruning", "false").csv(path, header=True, sep=sep, mode="DROPMALFORMED")
    return rows.where("frame_number is not null").withColumn("trace_id", F.regexp_extract("_metadata.file_name", r"([^/]*?)(\.[^.]*)?$", 1))


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow documents, one JSON object a file or line; the file's stem is the trace. Missing counts, times and header
    lengths are filled."""
    rows = spark.read.schema(schema.FLOW).json(path).withColumn("trace_id", F.regexp_extract("_metadata.file_name", r"([^/]*?)(\.[^.]*)?$", 1))
    records = lambda f: F.transform(f["tls_records"], lambda r: r.withField("time_epoch", F.coalesce(r["time_epoch"], f["time_epoch"])))
    filled = F.transform("frames", lambda f: f.withField("tls_records", records(f)).withField("ip_header_length", F.coalesce(f["ip_header_length"], F.lit(-1))).withField("tcp_header_length", F.coalesce(f["tcp_header_length"], F.lit(-1))))
    return rows.withColumns({"frames": filled, "total_num_frames": F.coalesce("total_num_frames", F.size("tls_records"))})


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """ip;domain files, one a page load named <url_id>[_...]; repeats within a file are dropped."""
    rows = spark.read.schema(schema.RESOLUTION).csv(path, sep=";").withColumns({"file": F.col("_metadata.file_name"), "folder": F.col("_metadata.file_path")})
    return rows.dropDuplicates(["folder", "ip", "domain"]).withColumn("url_id", F.regexp_extract("file", r"^(\d+)", 1).cast("long"))


def read_nf_stats(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schema.NF_STATS).csv(path, header=True, sep=";")
    return rows.withColumn("time", F.timestamp_millis("ts"))


def read_ttl(spark: SparkSession, path: str) -> DataFrame:
    """Enter or exit times; header and preamble lines are those whose second doesn't parse."""
    rows = spark.read.schema(schema.TTL).option("columnPruning", "false").csv(path, mode="PERMISSIVE")
    return rows.where("tv_sec is not null").withColumn("t", F.col("tv_sec") + F.col("tv_nsec") / 1e9)


def read_trials(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Per-trial JSON documents (configuration and result), the folder as trial_dir. lines: a document in each line, so that a
    folder's trials are a few files that can be split."""
    rows = spark.read.schema(schema.TRIAL).json(path, multiLine=not lines)
    return rows.withColumn("trial_dir", F.coalesce("trial_dir", F.regexp_extract("_metadata.file_path", r"([^/]*)/[^/]*$", 1)))


def read_confusions(spark: SparkSession, path: str) -> DataFrame:
    """(day, actual, predicted, n) of JSON documents {conf_mats or conf_mat: list or map of days}. Empty days are dropped."""
    text = spark.read.text(path, wholetext=True)
    counts = "map<string,map<string,bigint>>"
    body = F.coalesce(F.get_json_object("value", "$.conf_mats"), F.get_json_object("value", "$.conf_mat"))
    rows = text.select(body.alias("body"))
    as_list = rows.where(F.col("body").startswith("[")).select(F.posexplode(F.from_json("body", f"array<{counts}>")).alias("day", "conf")).select(F.col("day").cast("string"), "conf")
    as_map = rows.where(F.col("body").startswith("{")).select(F.explode(F.from_json("body", f"map<string,{counts}>")).alias("day", "conf"))
    days = as_list.unionByName(as_map).where(F.size("conf") > 0)
    return days.select("day", F.explode("conf").alias("actual", "row")).select("day", "actual", F.explode("row").alias("predicted", "n"))
