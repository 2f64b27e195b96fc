"""The flow data model derived from the star-schema tables, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.functions.symbols import edges_equal, nearest_edge, record_symbol
from flowlab.operators.windows import running

BIN_EDGES = (1500, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema; event times, which have no zone, are taken as the session's."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def dset_of(key) -> F.Column:
    """train, val or test by the first hex digit of an md5: 12, 2 and 2 of 16."""
    digit = F.substring(F.md5(key.cast("string")), 1, 1)
    return F.when(digit < "c", "train").when(digit < "e", "val").otherwise("test")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: a flow is a user's three days."""
    e = table(spark, sf_dir, "events")
    slot = F.expr("(day(ts) - 1) div 3").cast("int")
    own = Window.partitionBy("flow_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return (
        e.withColumn("flow_id", F.col("user_id") * 100 + slot)
        .withColumn("frame_number", F.row_number().over(own))
        .select(
            "flow_id", "user_id", F.concat(F.lit("L"), (F.col("user_id") % 7).cast("string")).alias("label"), slot.alias("day"), dset_of(F.col("user_id")).alias("dset"), "frame_number", (F.unix_micros("ts") / 1e6).alias("time_epoch"),
            F.when(kind.isin("click", "purchase", "signup"), -1).otherwise(1).alias("direction"), F.floor(F.col("value") * 3).cast("int").alias("tcp_length"),
            F.when(kind == "signup", 22).when(kind == "purchase", 20).when(kind == "error", 21).otherwise(23).alias("content_type"), F.when(kind == "signup", 1).alias("handshake_type"),
        )
    )


FRAMES = """frames AS (SELECT flow_id, user_id, 'L' || (user_id % 7) AS label, day, dset, row_number() OVER (PARTITION BY flow_id ORDER BY ts, event_id) AS frame_number, epoch(ts) AS time_epoch,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN -1 ELSE 1 END AS direction, CAST(floor(value * 3) AS INT) AS tcp_length,
  CASE event_type WHEN 'signup' THEN 22 WHEN 'purchase' THEN 20 WHEN 'error' THEN 21 ELSE 23 END AS content_type, CASE WHEN event_type = 'signup' THEN 1 END AS handshake_type
  FROM (SELECT *, (day(ts) - 1) // 3 AS day, user_id * 100 + (day(ts) - 1) // 3 AS flow_id, CASE WHEN md5(CAST(user_id AS VARCHAR))[1] < 'c' THEN 'train' WHEN md5(CAST(user_id AS VARCHAR))[1] < 'e' THEN 'val' ELSE 'test' END AS dset FROM events))"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with their symbols: `symbol` of type, bin and side, `letter` the same as one ASCII character."""
    f = frames(spark, sf_dir)
    bin_ = nearest_edge(F.col("tcp_length"), edges_equal(*BIN_EDGES))
    return f.withColumns({
        "bin": bin_,
        "symbol": record_symbol(F.col("direction"), F.col("tcp_length"), F.col("content_type"), F.col("handshake_type"), edges_equal(*BIN_EDGES)),
        "letter": F.char(65 + (F.col("content_type") - 20) * 8 + bin_ * 2 + F.when(F.col("direction") > 0, 1).otherwise(0)),
    })


SYMBOLS = FRAMES + """, binned AS (SELECT *, CASE WHEN tcp_length <= 250 THEN 0 WHEN tcp_length <= 750 THEN 1 WHEN tcp_length <= 1250 THEN 2 ELSE 3 END AS bin FROM frames),
symbols AS (SELECT *, content_type || coalesce(':' || handshake_type, '') || ';' || bin || ';' || CASE WHEN direction < 0 THEN 'C' ELSE 'S' END AS symbol,
  chr(65 + (content_type - 20) * 8 + bin * 2 + CASE WHEN direction > 0 THEN 1 ELSE 0 END) AS letter FROM binned)"""


def seqs(spark: SparkSession, sf_dir: str, column: str = "symbol") -> DataFrame:
    """One row per flow: flow_id, label, day, dset, seq."""
    s = symbols(spark, sf_dir)
    rows = s.groupBy("flow_id", "label", "day", "dset").agg(F.array_sort(F.collect_list(F.struct("frame_number", F.col(column).alias("s")))).alias("own"))
    return rows.select("flow_id", "label", "day", "dset", F.transform("own", lambda x: x["s"]).alias("seq"))


SEQS = SYMBOLS + """, seqs AS (SELECT flow_id, label, day, dset, list(symbol ORDER BY frame_number) AS seq, string_agg(letter, '' ORDER BY frame_number) AS word FROM symbols GROUP BY ALL)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seqs as one ASCII string per flow (`word`), for edit distances."""
    return seqs(spark, sf_dir, "letter").select("flow_id", "label", "day", "dset", F.concat_ws("", "seq").alias("word"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as TLS records: the order is the flow; all columns order the records, as line numbers repeat."""
    li = table(spark, sf_dir, "lineitem")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("flow_id"), F.row_number().over(own).alias("record_number"), F.when(F.col("l_linestatus") == "O", -1).otherwise(1).alias("direction"), (F.col("l_quantity") * 300).cast("int").alias("length"),
        F.when(flag == "A", 22).when(flag == "N", 23).otherwise(20).alias("content_type"), F.when(flag == "A", F.col("l_linenumber")).alias("handshake_type"),
    )


RECORDS = """records AS (SELECT l_orderkey AS flow_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS record_number,
  CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END AS direction, CAST(l_quantity * 300 AS INT) AS length, CASE l_returnflag WHEN 'A' THEN 22 WHEN 'N' THEN 23 ELSE 20 END AS content_type, CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS handshake_type FROM lineitem)"""


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The capture catalogue: nation = company, region = tag, customer = url, order = trace."""
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    urls = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit("."), (F.col("c_custkey") % 97).cast("string"), F.lit(".example.com/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_nationkey").alias("company"))
    return {
        "companies": n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("company")),
        "tags": r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("tag")),
        "tag_assignment": c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("tag_fk"), F.col("c_custkey").alias("trace_fk")),
        "urls": urls,
        "traces_metadata": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("url"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("filename"), F.col("o_orderdate").alias("start_capture"), F.when(F.col("o_orderpriority").startswith("1"), "Wget").otherwise("Firefox").alias("browser"), (F.col("o_orderstatus") == "F").alias("was_successful")),
        "jobs": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("url"), F.col("o_orderdate").alias("scheduled_date"), F.col("o_orderstatus").alias("state")),
    }


CATALOG = """companies AS (SELECT n_nationkey AS id, n_name AS company FROM nation), tags AS (SELECT r_regionkey AS id, r_name AS tag FROM region),
tag_assignment AS (SELECT n_regionkey AS tag_fk, c_custkey AS trace_fk FROM customer JOIN nation ON c_nationkey = n_nationkey),
urls AS (SELECT c_custkey AS id, 'https://' || lower(c_mktsegment) || '.' || (c_custkey % 97) || '.example.com/' || c_custkey AS url, c_nationkey AS company FROM customer),
traces_metadata AS (SELECT o_orderkey AS id, o_custkey AS url, 't' || o_orderkey AS filename, o_orderdate AS start_capture, CASE WHEN o_orderpriority LIKE '1%' THEN 'Wget' ELSE 'Firefox' END AS browser, o_orderstatus = 'F' AS was_successful FROM orders),
jobs AS (SELECT o_orderkey AS id, o_custkey AS url, o_orderdate AS scheduled_date, o_orderstatus AS state FROM orders)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets of page loads: user = host pair, hour of day = client port."""
    e = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    up = F.col("event_type").isin("click", "purchase", "signup")
    client, server = F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")), F.concat(F.lit("192.168."), (F.col("user_id") % 11).cast("string"), F.lit("."), (F.col("user_id") % 13).cast("string"))
    cport, sport = (40000 + F.hour("ts") % 4).cast("int"), F.lit(443)
    return e.withColumn("frame_number", F.row_number().over(own)).select(
        F.col("user_id").alias("trace_id"), "frame_number", (F.unix_micros("ts") / 1e6).alias("time_epoch"), F.when(up, client).otherwise(server).alias("ip_src"), F.when(up, server).otherwise(client).alias("ip_dst"),
        F.when(up, cport).otherwise(sport).alias("tcp_srcport"), F.when(up, sport).otherwise(cport).alias("tcp_dstport"), F.when(F.col("event_type") == "view", "TCP").when(F.col("event_type") == "error", "TLSv1").otherwise("TLSv1.2").alias("protocol"),
        (F.floor(F.col("value") * 3) + 40).cast("int").alias("frame_len"), F.floor(F.col("value") * 3).cast("int").alias("tcp_len"), F.when(F.col("event_type") == "signup", "Client Hello").otherwise("Application Data").alias("info"), F.when(F.col("event_type") == "signup", 1).alias("handshake_type"),
    )


PACKETS = """packets AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_number, epoch(ts) AS time_epoch, CASE WHEN up THEN client ELSE server END AS ip_src, CASE WHEN up THEN server ELSE client END AS ip_dst,
  CASE WHEN up THEN cport ELSE 443 END AS tcp_srcport, CASE WHEN up THEN 443 ELSE cport END AS tcp_dstport, CASE event_type WHEN 'view' THEN 'TCP' WHEN 'error' THEN 'TLSv1' ELSE 'TLSv1.2' END AS protocol,
  CAST(floor(value * 3) + 40 AS INT) AS frame_len, CAST(floor(value * 3) AS INT) AS tcp_len, CASE WHEN event_type = 'signup' THEN 'Client Hello' ELSE 'Application Data' END AS info, CASE WHEN event_type = 'signup' THEN 1 END AS handshake_type
  FROM (SELECT *, event_type IN ('click', 'purchase', 'signup') AS up, '10.0.0.' || (user_id % 50) AS client, '192.168.' || (user_id % 11) || '.' || (user_id % 13) AS server, 40000 + hour(ts) % 4 AS cport FROM events))"""


def nf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as counters of network functions: user mod 5 = service."""
    e = table(spark, sf_dir, "events")
    rows = e.withColumn("serviceid", (F.col("user_id") % 5).cast("int"))
    rows = running(rows, ["serviceid"], F.to_date("ts"), ["ts", "event_id"], {"n": F.lit(1), "rx": F.floor("value"), "cost": F.floor(F.col("value") * 10)})
    return rows.select(
        "serviceid", "n", F.unix_millis("ts").alias("ts"), (F.col("user_id") % 3).cast("int").alias("instanceid"), "rx", "cost", F.floor(F.col("value") * 5).alias("drop"), (F.col("user_id") % 4).alias("models"), F.date_format("ts", "yyyy-MM-dd").alias("run"),
    )


NF_STATS = """nf AS (SELECT user_id % 5 AS serviceid, row_number() OVER w AS n, epoch_us(ts) // 1000 AS ts, user_id % 3 AS instanceid, sum(CAST(floor(value) AS BIGINT)) OVER w AS rx, sum(CAST(floor(value * 10) AS BIGINT)) OVER w AS cost,
  CAST(floor(value * 5) AS BIGINT) AS drop, user_id % 4 AS models, strftime(ts, '%Y-%m-%d') AS run FROM events WINDOW w AS (PARTITION BY user_id % 5 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as DNS resolutions of page loads: order = page load, part = IP, supplier = domain."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("load"), F.concat(F.lit("10.1."), (F.col("l_partkey") % 200).cast("string"), F.lit(".1")).alias("ip"), F.concat(F.lit("d"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".example.com")).alias("domain"), (F.col("l_orderkey") % 23).alias("url_id")).distinct()


RESOLUTIONS = """resolutions AS (SELECT DISTINCT l_orderkey AS load, '10.1.' || (l_partkey % 200) || '.1' AS ip, 'd' || (l_suppkey % 40) || '.example.com' AS domain, l_orderkey % 23 AS url_id FROM lineitem)"""
