"""Queries over the catalogue, names, addresses, statistics of network functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions.text import hostname
from flowlab.operators import ipset as IP
from flowlab.operators import joins as J
from flowlab.operators import nfstats as N
from flowlab.operators import windows as W
from flowlab.plans import views as V
from flowlab.plans.base import query
from flowlab.plans.flows import PK, rounded
from flowlab.sources import readers as R
from flowlab.sources import writers as K
from flowlab.sources.storage import new_table

CA = f"WITH {V.CATALOG} "
NF = f"WITH {V.NF_STATS} "
RS = f"WITH {V.RESOLUTIONS}"


# sources and sinks: written, then read again by the reader under test


@query("s1_catalog", CA + "SELECT 'companies' AS name, count(*) AS n FROM companies UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'tag_assignment', count(*) FROM tag_assignment UNION ALL SELECT 'traces_metadata', count(*) FROM traces_metadata UNION ALL SELECT 'urls', count(*) FROM urls UNION ALL SELECT 'jobs', count(*) FROM jobs")
def s1(spark, d):
    path = new_table(spark, "catalog")
    for name, df in V.catalog(spark, d).items():
        df.write.parquet(f"{path}/{name}")
    out = None
    for name, df in R.read_catalog(spark, {"path": path}).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("s2_packets", PK + "SELECT frame_number, ip_src, ip_dst, protocol, frame_len, tcp_srcport, tcp_dstport, info FROM packets")
def s2(spark, d):
    path = new_table(spark, "packets")
    cols = ["frame_number", "time_epoch", "ip_src", "ip_dst", "protocol", "frame_len", "tcp_srcport", "tcp_dstport", "info"]
    V.packets(spark, d).select(*cols).write.csv(path, header=True, sep=";")
    return R.read_packets(spark, path, ";").drop("time_epoch", "trace_id")


@query("s3_flows", f"WITH {V.FRAMES} SELECT CAST(count(*) AS INT) AS frames FROM frames GROUP BY flow_id")
def s3(spark, d):
    path = new_table(spark, "flows")
    frame = F.struct("tcp_length", "frame_number", "time_epoch", "direction", F.array().cast("array<struct<length:int>>").alias("tls_records"))
    V.frames(spark, d).groupBy("flow_id").agg(F.collect_list(frame).alias("frames")).select("frames").write.json(path)
    return R.read_flows(spark, path).select(F.size("frames").alias("frames"))


@query("s4_resolutions", RS + " SELECT url_id, ip, domain, count(*) AS n FROM (SELECT DISTINCT url_id, ip, domain FROM resolutions) GROUP BY ALL")
def s4(spark, d):
    path = new_table(spark, "resolutions")
    rows = V.resolutions(spark, d).select("url_id", "ip", "domain").unionByName(V.resolutions(spark, d).select("url_id", "ip", "domain"))
    rows.write.partitionBy("url_id").csv(path, sep=";")
    read = R.read_resolutions(spark, path).withColumn("url_id", F.regexp_extract("folder", r"url_id=(\d+)", 1).cast("long"))
    return read.select("url_id", "ip", "domain").distinct().withColumn("n", F.lit(1).cast("long"))


@query("s5_nf_stats", NF + "SELECT serviceid, instanceid, count(*) AS n, CAST(max(rx) AS BIGINT) AS rx, make_timestamp(max(ts) * 1000) AS last FROM nf GROUP BY serviceid, instanceid")
def s5(spark, d):
    path = new_table(spark, "nf")
    V.nf_stats(spark, d).select("ts", "instanceid", "serviceid", "rx", F.col("cost").cast("double").alias("cost"), F.col("drop").alias("tx_drop"), F.lit(0).cast("long").alias("rx_drop")).write.csv(path, header=True, sep=";")
    return R.read_nf_stats(spark, path).groupBy("serviceid", "instanceid").agg(F.count("*").alias("n"), F.max("rx").alias("rx"), F.max("time").cast("timestamp_ntz").alias("last"))


@query("s6_ttl", "SELECT user_id, count(*) AS n, round(sum(epoch(ts)), 3) AS t FROM events WHERE event_type = 'click' GROUP BY user_id")
def s6(spark, d):
    path = new_table(spark, "ttl")
    us = F.unix_micros("ts")
    line = F.concat_ws(",", F.col("user_id").cast("string"), F.lit("1"), F.lit("h"), F.lit("443"), F.floor(us / 1_000_000).cast("string"), ((us % 1_000_000) * 1000).cast("string"))
    rows = V.table(spark, d, "events").where("event_type = 'click'").select(line.alias("value"))
    head = spark.createDataFrame([("some preamble",), ("src_ip,src_port,dst_ip,dst_port,tv_sec,tv_nsec",)], "value string")
    head.unionByName(rows).write.text(path)
    return R.read_ttl(spark, path).groupBy(F.col("src_ip").cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.round(F.sum("t"), 3).alias("t"))


@query("s7_trials", "SELECT 'knn' AS classifier, round(p_retailprice / 3000, 6) AS accuracy, p_size AS num_bins, p_brand AS trial_dir FROM part")
def s7(spark, d):
    path = new_table(spark, "trials")
    p = V.table(spark, d, "part")
    one = F.struct(F.col("p_partkey").cast("string").alias("uuid_"), F.lit("knn").alias("classifier"), F.col("p_size").alias("num_bins"), F.round(F.col("p_retailprice") / 3000, 6).alias("accuracy"), F.col("p_brand").alias("trial_dir"))
    p.select("p_brand", F.to_json(one).alias("value")).write.partitionBy("p_brand").text(path)
    return R.read_trials(spark, f"{path}/*/*.txt", lines=True).select("classifier", "accuracy", "num_bins", "trial_dir")


@query("s8_confusions", f"WITH {V.FRAMES} SELECT CAST(day AS VARCHAR) AS day, label AS actual, CAST(content_type AS VARCHAR) AS predicted, count(*) AS n FROM frames GROUP BY ALL")
def s8(spark, d):
    path = new_table(spark, "confusions")
    counts = V.frames(spark, d).groupBy("day", "label", "content_type").agg(F.count("*").alias("n"))
    rows = counts.groupBy("day", "label").agg(F.map_from_entries(F.collect_list(F.struct(F.col("content_type").cast("string"), "n"))).alias("row")).groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("label", "row"))).alias("conf"))
    rows.agg(F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), "conf"))).alias("conf_mats")).select(F.to_json(F.struct("conf_mats")).alias("value")).write.text(path)
    return R.read_confusions(spark, path)


@query("k1_dataset", f"WITH {V.SEQS} SELECT label, dset, count(*) AS n FROM seqs GROUP BY ALL")
def k1(spark, d):
    path = new_table(spark, "dataset")
    K.write_dataset(V.seqs(spark, d), path)
    return spark.read.parquet(path).groupBy("label", "dset").agg(F.count("*").alias("n"))


@query("k2_features", f"WITH {V.FRAMES} SELECT count(DISTINCT flow_id) AS n FROM frames")
def k2(spark, d):
    path = new_table(spark, "features")
    K.write_features(W.resample(W.cumulative(V.frames(spark, d)), 20, "signed").withColumnRenamed("points", "features"), path)
    return spark.read.parquet(path).where(F.size("features") == 20).agg(F.count("*").alias("n"))


@query("k3_model", f"WITH {V.SYMBOLS}, b AS (SELECT label, lag(symbol) OVER (PARTITION BY flow_id ORDER BY frame_number) AS tail, symbol AS head FROM symbols) SELECT label, count(DISTINCT coalesce(tail, 'START') || '>' || head) AS n FROM b GROUP BY label")
def k3(spark, d):
    from flowlab.operators.chains import fit_chain

    path = new_table(spark, "model")
    K.write_model(fit_chain(V.seqs(spark, d)), path)
    return K.read_model(spark, path).groupBy("label").agg(F.count("*").alias("n"))


@query("k4_predictions", f"WITH {V.FRAMES} SELECT flow_id, (SELECT CAST(count(DISTINCT label) AS INT) FROM frames WHERE dset = 'train') AS models FROM (SELECT DISTINCT flow_id FROM frames WHERE dset = 'test')")
def k4(spark, d):
    from flowlab.operators.chains import fit_chain, score_chain

    s = V.seqs(spark, d)
    scores = score_chain(s.where("dset = 'test'"), fit_chain(s.where("dset = 'train'")))
    rows = scores.groupBy("flow_id").agg(F.map_from_entries(F.collect_list(F.struct("model_label", "score"))).alias("likelihoods"))
    path = new_table(spark, "predictions")
    for _ in range(2):  # as after a failure: the rows are there once
        K.write_predictions(rows, path)
    return K.read_predictions(spark, path).select("flow_id", F.size("likelihoods").alias("models"))


@query("k5_assign_tags", CA + ", h AS (SELECT id, regexp_extract(url, '^https://([^/]*)', 1) AS host FROM urls), ht AS (SELECT DISTINCT host, split_part(host, '.', 1) AS tag FROM h), new AS (SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY tag) AS id, tag FROM (SELECT DISTINCT tag FROM ht WHERE tag NOT IN (SELECT tag FROM tags))) SELECT CAST(new.id AS BIGINT) AS tag_fk, h.id AS trace_fk FROM h JOIN ht USING (host) JOIN new USING (tag)")
def k5(spark, d):
    c = V.catalog(spark, d)
    host_tags = J.hosts_of(c["urls"]).select("host", F.split_part("host", F.lit("."), F.lit(1)).alias("tag")).distinct()
    return J.assign_tags(c["urls"], c["tags"], host_tags)[1]


@query("k6_file_index", CA + ", t AS (SELECT *, CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 9 THEN 'val' ELSE 'test' END AS dset FROM traces_metadata), g AS (SELECT c.company, b.browser, s.dset FROM (SELECT DISTINCT company FROM urls) c, (SELECT DISTINCT browser FROM traces_metadata) b, (VALUES ('train'), ('val'), ('test')) s(dset)), f AS (SELECT u.company, browser, dset, count(*) AS n, min(filename) AS first FROM t JOIN urls u ON u.id = t.url GROUP BY ALL) SELECT company, browser, dset, coalesce(n, 0) AS n, first FROM g LEFT JOIN f USING (company, browser, dset)")
def k6(spark, d):
    c = V.catalog(spark, d)
    t = c["traces_metadata"].withColumn("dset", F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 9, "val").otherwise("test"))
    rows = J.export_file_index(t, c["urls"], t.select("browser").distinct())
    return rows.select("company", "browser", "dset", F.size("files").cast("long").alias("n"), F.array_min("files").alias("first"))


@query("k7_job_rows", CA + "SELECT id AS url, browser, 'scheduled' AS state FROM urls, (VALUES ('Firefox'), ('Wget')) b(browser)")
def k7(spark, d):
    b = spark.createDataFrame([("Firefox",), ("Wget",)], "browser string")
    return J.job_rows(V.catalog(spark, d)["urls"], b, F.current_timestamp()).drop("scheduled_date")


# joins


@query("j1_traces_with_urls", CA + "SELECT t.id, u.url AS address, u.company FROM traces_metadata t JOIN urls u ON t.url = u.id")
def j1(spark, d):
    c = V.catalog(spark, d)
    return J.traces_with_urls(c["traces_metadata"], c["urls"]).select("id", "address", "company")


@query("j2_traces_with_tags", CA + "SELECT filename, min(tag) AS tag FROM traces_metadata t JOIN urls u ON t.url = u.id JOIN tag_assignment ON trace_fk = u.id JOIN tags g ON g.id = tag_fk GROUP BY filename")
def j2(spark, d):
    c = V.catalog(spark, d)
    return J.traces_with_tags(c["traces_metadata"], c["urls"], c["tag_assignment"], c["tags"])


@query("j2_traces_with_tag_lists", CA + "SELECT filename, array_to_string(list(tag ORDER BY tag), ',') AS tags FROM traces_metadata t JOIN urls u ON t.url = u.id JOIN tag_assignment ON trace_fk = u.id JOIN tags g ON g.id = tag_fk GROUP BY filename")
def j2_list(spark, d):
    c = V.catalog(spark, d)
    return J.traces_with_tags(c["traces_metadata"], c["urls"], c["tag_assignment"], c["tags"], as_list=True).select("filename", F.array_join("tags", ",").alias("tags"))


@query("j3_day_range", "WITH days AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 9 HOURS AS day FROM events) SELECT event_id AS id, day FROM events, days WHERE ts >= day AND ts < day + INTERVAL 5 HOURS")
def j3(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("start_capture"))
    days = e.select((F.date_trunc("day", "start_capture") + F.expr("INTERVAL 9 HOURS")).alias("day")).distinct()
    return J.traces_by_day(e, days).select("id", F.col("day").cast("timestamp_ntz").alias("day"))


SPLIT = ", ind AS (SELECT id AS url, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS dset FROM urls WHERE id % 7 <> 0), lab AS (SELECT id AS url, 'L' || (id % 4) AS tag FROM urls WHERE id % 11 <> 0) "


def _split(spark, d):
    c = V.catalog(spark, d)
    u = c["urls"]
    ind = u.where("id % 7 <> 0").select(F.col("id").alias("url"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("dset"))
    lab = u.where("id % 11 <> 0").select(F.col("id").alias("url"), F.concat(F.lit("L"), (F.col("id") % 4).cast("string")).alias("tag"))
    return J.with_split_and_label(c["traces_metadata"], ind, lab)


@query("j4_split_and_label", CA + SPLIT + "SELECT t.id, dset, tag FROM traces_metadata t JOIN ind USING (url) JOIN lab USING (url)")
def j4(spark, d):
    return _split(spark, d)[0].select("id", "dset", "tag")


@query("j4_skipped", CA + SPLIT + "SELECT count(*) AS skipped FROM traces_metadata WHERE url NOT IN (SELECT url FROM ind) OR url NOT IN (SELECT url FROM lab)")
def j4_skipped(spark, d):
    return _split(spark, d)[1]


@query("j5_align_keys", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)) AS a, (SELECT count(*) FROM lineitem WHERE l_quantity > 40 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')) AS b, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)) AS c")
def j5(spark, d):
    o = V.table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    li = V.table(spark, d, "lineitem").where("l_quantity > 40").withColumnRenamed("l_orderkey", "k")
    n = lambda df, c: df.agg(F.count("*").alias(c))
    left, right = J.align_keys(o.where("o_orderstatus <> 'F'"), li, "k")
    return n(J.align_keys(o, li, "k")[0], "a").crossJoin(n(right, "b")).crossJoin(n(left, "c"))


def _address(spark, d):
    from flowlab.operators.selection import client_hellos

    hello = client_hellos(V.packets(spark, d))
    return J.first_address(hello.select("trace_id", "frame_number", F.concat(F.col("ip_dst"), F.lit(",10.9.9.9")).alias("dns_a")), ["trace_id"])


@query("j6_main_flow", PK + ", hello AS (SELECT trace_id, arg_min({'c': ip_src, 'p': tcp_srcport, 's': ip_dst}, frame_number) AS h FROM packets WHERE handshake_type = 1 GROUP BY trace_id) SELECT trace_id, frame_number FROM packets JOIN hello USING (trace_id) WHERE (ip_src = h.c AND tcp_srcport = h.p AND ip_dst = h.s AND tcp_dstport = 443) OR (ip_dst = h.c AND tcp_dstport = h.p AND ip_src = h.s AND tcp_srcport = 443)")
def j6(spark, d):
    return J.main_flow_packets(V.packets(spark, d), _address(spark, d)).select("trace_id", "frame_number")


@query("j7_first_address", PK + "SELECT trace_id, arg_min(ip_dst, frame_number) AS address FROM packets WHERE handshake_type = 1 GROUP BY trace_id")
def j7(spark, d):
    return _address(spark, d)


ENDS = "CASE WHEN (ip_src, tcp_srcport) <= (ip_dst, tcp_dstport) THEN ip_src || ':' || tcp_srcport || ':' || ip_dst || ':' || tcp_dstport ELSE ip_dst || ':' || tcp_dstport || ':' || ip_src || ':' || tcp_srcport END"


@query("j8_co_flow", PK + f", k AS (SELECT *, {ENDS} AS key FROM packets), h AS (SELECT * FROM k WHERE handshake_type = 1 OR info LIKE '%Client Hello%'), m AS (SELECT trace_id, arg_min(key, frame_number) AS main FROM h GROUP BY trace_id), o AS (SELECT trace_id, arg_min(key, md5('3:' || key)) AS key FROM h JOIN m USING (trace_id) WHERE key <> main GROUP BY trace_id) SELECT trace_id, frame_number FROM k JOIN o USING (trace_id, key)")
def j8(spark, d):
    return J.co_flow_packets(V.packets(spark, d), 3).select("trace_id", "frame_number")


@query("j13_time_to_label", "WITH e AS (SELECT user_id, min(epoch(ts)) AS enter FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT user_id, round(enter, 3) AS enter, round(min(epoch(ts)), 3) AS exit, round(min(epoch(ts)) - enter, 3) AS delta FROM events JOIN e USING (user_id) WHERE event_type = 'purchase' AND epoch(ts) >= enter AND epoch(ts) <= enter + 36000 GROUP BY user_id, enter")
def j13(spark, d):
    return _ttl(spark, d).select("user_id", *[F.round(c, 3).alias(c) for c in ("enter", "exit", "delta")])


def _ttl(spark, d):
    e = V.table(spark, d, "events").withColumn("t", F.unix_micros("ts") / 1e6).select("user_id", "event_type", "t")
    return J.time_to_label(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), ["user_id"], 36000)


@query("j14_destinations", PK + ", f AS (SELECT * FROM packets QUALIFY row_number() OVER (PARTITION BY trace_id, protocol, ip_src, tcp_srcport, ip_dst, tcp_dstport ORDER BY frame_number) = 1), n AS (SELECT ip_dst AS ip, arg_min('d' || trace_id, trace_id * 1000000 + frame_number) AS domain FROM packets WHERE handshake_type = 1 GROUP BY ip_dst) SELECT trace_id, frame_number, domain FROM f JOIN n ON ip_dst = ip")
def j14(spark, d):
    from flowlab.operators.selection import client_hellos

    p = V.packets(spark, d)
    dns = client_hellos(p).select(F.col("ip_dst").alias("ip"), F.concat(F.lit("d"), F.col("trace_id").cast("string")).alias("domain"), (F.col("trace_id") * 1000000 + F.col("frame_number")).alias("frame_number"))
    return J.destinations_by_domain(p, dns).select("trace_id", "frame_number", "domain")


HOSTS = ", hosts AS (SELECT i AS url_id, 'L' || (i % 6) AS label, 'd' || i || '.example.com' AS host FROM range(23) AS r(i))"
ENTROPY = ", pairs AS (SELECT DISTINCT load, domain FROM resolutions), ent AS (SELECT domain, -ln(count(*) / (SELECT count(*) FROM pairs)) AS entropy FROM pairs GROUP BY domain), ipent AS (SELECT ip, avg(entropy) AS entropy FROM (SELECT DISTINCT ip, domain FROM resolutions) JOIN ent USING (domain) GROUP BY ip)"
SETS = ", own AS (SELECT * FROM resolutions JOIN hosts USING (url_id) WHERE load % 10 < 8), prim AS (SELECT DISTINCT label, ip FROM own WHERE domain = host), sec AS (SELECT DISTINCT label, ip FROM own WHERE domain <> host AND (label, ip) NOT IN (SELECT label, ip FROM prim))"
PAGES = ", pages_ AS (SELECT DISTINCT load, ip, domain = host AS is_primary FROM resolutions JOIN hosts USING (url_id) WHERE load % 10 >= 8), cand AS (SELECT DISTINCT load, label FROM pages_ JOIN prim USING (ip) WHERE is_primary), other AS (SELECT load, label, sum(entropy) AS score FROM (SELECT DISTINCT load, ip FROM pages_ WHERE NOT is_primary) JOIN sec USING (ip) JOIN ipent USING (ip) GROUP BY ALL), scored AS (SELECT load, label, coalesce(score, 0) AS score FROM cand LEFT JOIN other USING (load, label))"


def _hosts(spark):
    return spark.range(23).select(F.col("id").alias("url_id"), F.concat(F.lit("L"), (F.col("id") % 6).cast("string")).alias("label"), F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".example.com")).alias("host"))


def _scored(spark, d):
    r, h = V.resolutions(spark, d), _hosts(spark)
    primary, secondary = IP.ip_sets(r.where("load % 10 < 8"), h)
    pages = r.where("load % 10 >= 8").join(F.broadcast(h), "url_id").select("load", "ip", (F.col("domain") == F.col("host")).alias("is_primary")).distinct()
    return IP.score_ipset(pages, primary, secondary, IP.entropies(r)[1])


@query("j15_ipset_scores", RS + HOSTS + ENTROPY + SETS + PAGES + " SELECT load, label, round(score, 6) AS score FROM scored")
def j15(spark, d):
    return _scored(spark, d).withColumn("score", F.round("score", 6))


@query("m11_ipset_classify", RS + HOSTS + ENTROPY + SETS + PAGES + " SELECT load, arg_min(label, {'s': -round(score, 9), 'l': label}) AS predicted, round(max(score), 6) AS score FROM scored GROUP BY load")
def m11(spark, d):
    return IP.ipset_classify(_scored(spark, d)).withColumn("score", F.round("score", 6))


@query("a22_domain_entropy", RS + ENTROPY + " SELECT domain, round(entropy, 6) AS entropy FROM ent")
def a22(spark, d):
    return rounded(IP.entropies(V.resolutions(spark, d))[0], "domain")


@query("a22_ip_entropy", RS + ENTROPY + " SELECT ip, round(entropy, 6) AS entropy FROM ipent")
def a22_ip(spark, d):
    return rounded(IP.entropies(V.resolutions(spark, d))[1], "ip")


@query("a23_ip_sets", RS + HOSTS + SETS + " SELECT 'primary' AS role, label, ip FROM prim UNION ALL SELECT 'secondary', label, ip FROM sec")
def a23(spark, d):
    primary, secondary = IP.ip_sets(V.resolutions(spark, d).where("load % 10 < 8"), _hosts(spark))
    return primary.withColumn("role", F.lit("primary")).unionByName(secondary.withColumn("role", F.lit("secondary")))


@query("j16_with_truth", CA + "SELECT filename, browser AS predicted, 'L' || (u.id % 4) AS actual FROM traces_metadata t JOIN urls u ON u.id = t.url")
def j16(spark, d):
    c = V.catalog(spark, d)
    pred = c["traces_metadata"].select("filename", F.col("browser").alias("predicted"))
    labels = c["urls"].select(F.col("id").alias("url"), F.concat(F.lit("L"), (F.col("id") % 4).cast("string")).alias("tag"))
    return J.with_truth(pred, c["traces_metadata"], labels).select("filename", "predicted", "actual")


ASN = " , pre AS (SELECT * FROM (VALUES ('10.0.0.0', 8, 1), ('10.1.0.0', 16, 2), ('10.1.64.0', 18, 3), ('10.1.7.0', 24, 4), ('10.1.100.0', 23, 5)) v(prefix, len, asn)), ips AS (SELECT DISTINCT ip FROM resolutions), num AS (SELECT ip, list_sum(list_transform(string_split(ip, '.'), lambda x, i: CAST(x AS BIGINT) * CAST(pow(256, 4 - i) AS BIGINT))) AS v FROM ips), np AS (SELECT len, asn, list_sum(list_transform(string_split(prefix, '.'), lambda x, i: CAST(x AS BIGINT) * CAST(pow(256, 4 - i) AS BIGINT))) AS v FROM pre) "


@query("j17_ip_to_asn", RS + ASN + "SELECT ip, arg_max(asn, len) AS asn FROM num JOIN np ON CAST(num.v AS BIGINT) >> (32 - len) = CAST(np.v AS BIGINT) >> (32 - len) GROUP BY ip")
def j17(spark, d):
    pre = spark.createDataFrame([("10.0.0.0", 8, 1), ("10.1.0.0", 16, 2), ("10.1.64.0", 18, 3), ("10.1.7.0", 24, 4), ("10.1.100.0", 23, 5)], "prefix string, len int, asn int")
    return J.ip_to_asn(V.resolutions(spark, d).select("ip").distinct(), pre)


@query("j18_pending", "SELECT p_partkey AS id, p_brand AS method FROM part WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS b, p_brand AS m FROM part WHERE p_partkey % 2 = 0) d WHERE d.m = p_brand AND d.b IS NOT DISTINCT FROM CASE WHEN part.p_size % 3 = 0 THEN NULL ELSE part.p_size END)")
def j18(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("method"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("bins"))
    return J.pending(p, p.where("id % 2 = 0").select("method", "bins")).select("id", "method")


@query("j19_records_in_frames", f"WITH {V.RECORDS}, r AS (SELECT flow_id, direction, record_number, CAST(sum(length) OVER w AS BIGINT) - length AS lo, CAST(sum(length) OVER w AS BIGINT) AS hi FROM records WINDOW w AS (PARTITION BY flow_id, direction ORDER BY record_number)), t AS (SELECT flow_id, direction, max(hi) AS total FROM r GROUP BY ALL), s AS (SELECT flow_id, direction, i AS frame_number, i * 1400 AS lo, least((i + 1) * 1400, total) AS hi FROM t, range(400) AS g(i) WHERE i * 1400 < total) SELECT flow_id, direction, frame_number, record_number FROM s JOIN r USING (flow_id, direction) WHERE s.lo < r.hi AND r.lo < s.hi")
def j19(spark, d):
    from pyspark.sql import Window

    run = Window.partitionBy("flow_id", "direction").orderBy("record_number").rowsBetween(Window.unboundedPreceding, 0)
    spans = V.records(spark, d).select("flow_id", "direction", "record_number", (F.sum("length").over(run) - F.col("length")).alias("lo"), F.sum("length").over(run).alias("hi"))
    seg = spans.groupBy("flow_id", "direction").agg(F.max("hi").alias("total")).select("flow_id", "direction", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / 1400))).alias("frame_number"))
    seg = seg.select("flow_id", "direction", "frame_number", (F.col("frame_number") * 1400).alias("lo"), F.least((F.col("frame_number") + 1) * 1400, F.col("total")).alias("hi"))
    return J.records_in_frames(seg, spans).select("flow_id", "direction", "frame_number", "record_number")


# statistics of network functions


@query("w7_diffs", NF + "SELECT serviceid, n, CAST(rx - lag(rx) OVER w AS BIGINT) AS d_rx, CAST(cost - lag(cost) OVER w AS BIGINT) AS d_cost FROM nf WINDOW w AS (PARTITION BY serviceid ORDER BY n)")
def w7(spark, d):
    return W.diffs(V.nf_stats(spark, d), "serviceid", "n", ["rx", "cost"]).select("serviceid", "n", "d_rx", "d_cost")


@query("w8_experiment_slice", "WITH e AS (SELECT event_id, epoch_ms(ts) AS ts, user_id % 3 AS instanceid, CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 + day(ts) ELSE 100 END AS rx FROM events), b AS (SELECT max(ts) FILTER (rx = 0) AS s, min(ts) FILTER (rx = 100) AS e FROM e WHERE instanceid = 1) SELECT event_id FROM e, b WHERE ts > s AND ts < b.e")
def w8(spark, d):
    day = F.col("ts")
    e = V.table(spark, d, "events").select("event_id", F.unix_millis("ts").alias("ms"), (F.col("user_id") % 3).alias("instanceid"), F.when(day < F.lit("2024-01-05").cast("timestamp"), 0).when(day < F.lit("2024-01-20").cast("timestamp"), 1 + F.day("ts")).otherwise(100).alias("rx"))
    return W.experiment_slice(e.withColumnRenamed("ms", "ts")).select("event_id")


@query("a32_cost_per_packet", NF + ", x AS (SELECT serviceid, n, CAST(rx - lag(rx) OVER w AS BIGINT) AS d_rx, CAST(cost - lag(cost) OVER w AS BIGINT) AS d_cost FROM nf WINDOW w AS (PARTITION BY serviceid ORDER BY n)) SELECT serviceid, n, round(d_cost / d_rx, 6) AS cost_per_packet FROM x WHERE d_rx > 0")
def a32(spark, d):
    return N.cost_per_packet(V.nf_stats(spark, d)).select("serviceid", "n", F.round("cost_per_packet", 6).alias("cost_per_packet"))


RUNS = ", runs AS (SELECT models + 1 AS models, run, coalesce(max(drop) FILTER (serviceid >= 3) > 1000, false) AS dropped FROM nf GROUP BY ALL)"


def _runs(spark, d):
    nf = V.nf_stats(spark, d).withColumn("key", F.struct((F.col("models") + 1).alias("models"), "run"))
    return N.drops(nf, key="key").select("key.*", "dropped")


@query("a33_drops", NF + RUNS + "SELECT models, run, dropped FROM runs")
def a33_drops(spark, d):
    return _runs(spark, d)


@query("a33_capacity", NF + RUNS + ", f AS (SELECT *, min(models) FILTER (dropped) OVER (PARTITION BY run) AS first FROM runs) SELECT run, CAST(CASE WHEN max(first) IS NULL THEN 10 ELSE coalesce(max(models) FILTER (models < first), 1) END AS INT) AS capacity FROM f GROUP BY run")
def a33(spark, d):
    return N.capacity(_runs(spark, d), "run")


@query("a34_latency", "WITH e AS (SELECT user_id, min(epoch(ts)) AS enter FROM events WHERE event_type = 'click' GROUP BY user_id), t AS (SELECT user_id, min(epoch(ts)) - enter AS delta FROM events JOIN e USING (user_id) WHERE event_type = 'purchase' AND epoch(ts) >= enter AND epoch(ts) <= enter + 36000 GROUP BY user_id, enter) SELECT round(avg(delta), 3) AS mean, round(quantile_cont(delta, 0.5), 3) AS median, round(quantile_cont(delta, 0.95), 3) AS p95, round(quantile_cont(delta, 0.975), 3) AS p975, round(quantile_cont(delta, 0.99), 3) AS p99 FROM t")
def a34(spark, d):
    rows = N.latency_summary(_ttl(spark, d))
    return rows.select(*[F.round(c, 3).alias(c) for c in rows.columns])


@query("p1_hosts_strict", "SELECT regexp_extract(url, '^https://([^/]*)', 1) AS host, count(*) AS n FROM pages WHERE url LIKE 'https://%' GROUP BY host")
def p1_strict(spark, d):
    return V.table(spark, d, "pages").where(F.col("url").startswith("https://")).groupBy(hostname(F.col("url"), strict=True).alias("host")).agg(F.count("*").alias("n"))
