"""Queries over frames, records and packets: projections, filters, windows, per-flow statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions import symbols as S
from flowlab.functions import text as X
from flowlab.operators import aggregates as A
from flowlab.operators import selection as P
from flowlab.operators import windows as W
from flowlab.plans import views as V
from flowlab.plans.base import query

FR, RE, PK, SY, SQ = (f"WITH {x} " for x in (V.FRAMES, V.RECORDS, V.PACKETS, V.SYMBOLS, V.SEQS))
CA = f"WITH {V.CATALOG} "
PAGE = "SELECT page_id, url FROM pages"


@query("p1_hostname", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN regexp_extract(url, '^https://([^/]*)', 1) END AS host FROM pages")
def p1(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.hostname(F.col("url")).alias("host"))


@query("p2_resolver_host", "SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)', 1) AS host FROM pages")
def p2(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.resolver_host(F.col("url")).alias("host"))


@query("p3_tls_rows", PK + "SELECT trace_id, frame_number, protocol FROM packets WHERE protocol IN ('TLSv1', 'TLSv1.2', 'TLSv1.3')")
def p3(spark, d):
    return V.packets(spark, d).where(X.is_tls(F.col("protocol"))).select("trace_id", "frame_number", "protocol")


@query("p4_payload_only", PK + "SELECT trace_id, frame_number, tcp_len FROM packets WHERE tcp_len > 0")
def p4(spark, d):
    return V.packets(spark, d).where(X.has_payload(F.col("tcp_len"))).select("trace_id", "frame_number", "tcp_len")


@query("p5_client_hellos", PK + "SELECT trace_id, frame_number, ip_src, ip_dst, tcp_srcport, tcp_dstport FROM packets WHERE handshake_type = 1 OR info LIKE '%Client Hello%'")
def p5(spark, d):
    return P.client_hellos(V.packets(spark, d)).select("trace_id", "frame_number", "ip_src", "ip_dst", "tcp_srcport", "tcp_dstport")


@query("p6_browser", CA + "SELECT browser, count(*) AS n FROM traces_metadata WHERE browser NOT LIKE '%Wget%' GROUP BY browser UNION ALL SELECT 'wget', count(*) FROM traces_metadata WHERE browser LIKE '%Wget%'")
def p6(spark, d):
    t = V.catalog(spark, d)["traces_metadata"]
    other = t.where(X.browser_is(F.col("browser"), "other")).groupBy("browser").agg(F.count("*").alias("n"))
    return other.unionByName(t.where(X.browser_is(F.col("browser"), "wget")).agg(F.count("*").alias("n")).withColumn("browser", F.lit("wget")))


@query("p7_drop_labels", "SELECT page_id, tag FROM (SELECT page_id, split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '.', 1) AS tag FROM pages) WHERE tag NOT IN ('browser', 'captcha', 'cdn', 'dns', 'unknown', 'www', 'blog', '')")
def p7(spark, d):
    tag = F.split_part(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1)), F.lit("."), F.lit(1))
    return P.drop_labels(V.table(spark, d, "pages").select("page_id", tag.alias("tag")), (*P.INFRASTRUCTURE, "www", "blog"))


@query("p8_label_like", CA + "SELECT id, tag FROM tags WHERE tag LIKE '%A%'")
def p8(spark, d):
    return P.label_like(V.catalog(spark, d)["tags"], "%A%")


@query("p9_direction", PK + ", first AS (SELECT trace_id, arg_min(ip_src, frame_number) AS client FROM packets WHERE ip_src LIKE '10.%' GROUP BY trace_id) SELECT trace_id, frame_number, CASE WHEN ip_src = client THEN -1 ELSE 1 END AS direction FROM packets LEFT JOIN first USING (trace_id)")
def p9(spark, d):
    return P.with_direction(V.packets(spark, d), prefix="10.").select("trace_id", "frame_number", "direction")


HORIZON = ", late AS (SELECT *, max(time_epoch) OVER (PARTITION BY flow_id ORDER BY frame_number) - first_value(time_epoch) OVER (PARTITION BY flow_id ORDER BY frame_number) AS latest FROM frames) "


@query("p10_horizon", FR + HORIZON + "SELECT flow_id, frame_number FROM late WHERE latest <= 86400")
def p10(spark, d):
    return P.within_horizon(V.frames(spark, d), 86400).select("flow_id", "frame_number")


@query("p11_select_elements", RE + "SELECT flow_id, record_number, content_type FROM records WHERE handshake_type IS NULL AND direction <> 1")
def p11(spark, d):
    return P.select_elements(V.records(spark, d), True, 1).select("flow_id", "record_number", "content_type")


def _nested(spark, d):
    rows = V.frames(spark, d).groupBy("flow_id", "label").agg(F.array_sort(F.collect_list(F.struct("frame_number", "tcp_length", "direction"))).alias("frames"))
    return rows


@query("p12_head_frames", FR + "SELECT flow_id, least(count(*), 8) AS kept, CAST(sum(tcp_length) FILTER (frame_number <= 8) AS BIGINT) AS bytes FROM frames GROUP BY flow_id HAVING count(*) >= 6")
def p12(spark, d):
    return P.head_frames(_nested(spark, d), 8, 6).select("flow_id", F.size("frames").cast("long").alias("kept"), F.aggregate("frames", F.lit(0).cast("long"), lambda acc, f: acc + f["tcp_length"]).alias("bytes"))


@query("p13_plausible", FR + "SELECT flow_id, count(*) AS frames FROM frames GROUP BY flow_id HAVING max(tcp_length) <= 600 AND count(*) >= 4")
def p13(spark, d):
    return P.plausible(_nested(spark, d), 600, 4).select("flow_id", F.size("frames").cast("long").alias("frames"))


@query("p14_signed_size", FR + "SELECT flow_id, frame_number, tcp_length * direction AS size FROM frames")
def p14(spark, d):
    return V.frames(spark, d).select("flow_id", "frame_number", X.signed_size(F.col("tcp_length"), F.col("direction")).alias("size"))


NAMES = "CASE content_type WHEN 20 THEN 'CHANGE_CIPHER_SPEC' WHEN 21 THEN 'ALERT' WHEN 23 THEN 'APPLICATION_DATA' WHEN 22 THEN CASE handshake_type WHEN 0 THEN 'HELLO_REQUEST' WHEN 1 THEN 'CLIENT_HELLO' WHEN 2 THEN 'SERVER_HELLO' WHEN 4 THEN 'NEW_SESSION_TICKET' WHEN 11 THEN 'CERTIFICATE' WHEN 12 THEN 'SERVER_KEY_EXCHANGE' WHEN 14 THEN 'SERVER_HELLO_DONE' WHEN 16 THEN 'CLIENT_KEY_EXCHANGE' WHEN 20 THEN 'FINISHED' ELSE 'ENCRYPTED_HANDSHAKE_MESSAGE' END END"


@query("p15_type_names", RE + f"SELECT {NAMES} AS name, count(*) AS n FROM records GROUP BY name")
def p15(spark, d):
    return V.records(spark, d).groupBy(X.record_type_name(F.col("content_type"), F.col("handshake_type")).alias("name")).agg(F.count("*").alias("n"))


KEY = "CASE WHEN (ip_src, tcp_srcport) <= (ip_dst, tcp_dstport) THEN ip_src || ':' || tcp_srcport || '-' || ip_dst || ':' || tcp_dstport ELSE ip_dst || ':' || tcp_dstport || '-' || ip_src || ':' || tcp_srcport END"


def _key_text():
    k = X.flow_key(F.col("ip_src"), F.col("tcp_srcport"), F.col("ip_dst"), F.col("tcp_dstport"))
    return F.concat(k["low"]["ip"], F.lit(":"), k["low"]["port"].cast("string"), F.lit("-"), k["high"]["ip"], F.lit(":"), k["high"]["port"].cast("string"))


@query("p16_flow_key", PK + f"SELECT {KEY} AS key, count(*) AS n FROM packets GROUP BY key")
def p16(spark, d):
    return V.packets(spark, d).groupBy(_key_text().alias("key")).agg(F.count("*").alias("n"))


DRAW = "('0x' || substr(md5('7:' || {}), 1, 8))::BIGINT / 4294967296.0"


@query("p17_random_drop", SQ + ", n AS (SELECT flow_id, label, count(*) AS n FROM symbols GROUP BY ALL), k AS (SELECT flow_id, string_agg(symbol, ',' ORDER BY frame_number) AS s FROM symbols WHERE " + DRAW.format("flow_id") + " >= 0.5 OR " + DRAW.format("flow_id || ':' || (frame_number - 1)") + " >= 0.3 GROUP BY flow_id) SELECT flow_id, label, coalesce(s, '') AS seq FROM n LEFT JOIN k USING (flow_id)")
def p17(spark, d):
    return P.random_drop(V.seqs(spark, d), 0.3, 7).select("flow_id", "label", F.array_join("seq", ",").alias("seq"))


@query("p18_exclude_prefix", CA + "SELECT id, filename FROM traces_metadata WHERE NOT (browser = 'Wget' AND filename LIKE 't1%')")
def p18(spark, d):
    t = V.catalog(spark, d)["traces_metadata"].withColumnRenamed("browser", "label")
    return P.exclude_prefix(t, "Wget", "t1").select("id", "filename")


@query("p19_failures", "SELECT CASE WHEN url NOT LIKE 'https://%' THEN 'not https' WHEN url LIKE '%#%' THEN 'fragment' END AS reason, count(*) AS n FROM pages WHERE url NOT LIKE 'https://%' OR url LIKE '%#%' GROUP BY reason")
def p19(spark, d):
    u = F.col("url")
    failed = V.table(spark, d, "pages").select(F.when(~u.startswith("https://"), "not https").when(F.contains(u, F.lit("#")), "fragment").alias("reason"))
    return P.failure_summary(failed.where("reason is not null"))


# aggregates


@query("a1_frame_counts", FR + "SELECT flow_id, count(*) AS total, count(*) FILTER (direction > 0) AS incoming, count(*) FILTER (direction < 0) AS outgoing FROM frames GROUP BY flow_id")
def a1(spark, d):
    return A.frame_counts(V.frames(spark, d))


@query("a2_record_counts", RE + ", per AS (SELECT flow_id, direction, count(*) AS n_records FROM records GROUP BY ALL) SELECT flow_id, CAST(sum(n_records) AS BIGINT) AS total, CAST(coalesce(sum(n_records) FILTER (direction > 0), 0) AS BIGINT) AS incoming, CAST(coalesce(sum(n_records) FILTER (direction < 0), 0) AS BIGINT) AS outgoing FROM per GROUP BY flow_id")
def a2(spark, d):
    return A.record_counts(V.records(spark, d).groupBy("flow_id", "direction").agg(F.count("*").alias("n_records")))


@query("a3_handshake_counts", FR + "SELECT flow_id, count(*) FILTER (content_type = 22) AS total, count(*) FILTER (content_type = 22 AND direction > 0) AS incoming, count(*) FILTER (content_type = 22 AND direction < 0) AS outgoing FROM frames GROUP BY flow_id")
def a3(spark, d):
    return A.handshake_counts(V.frames(spark, d))


def _eight(v, p=""):
    q = ", ".join(f"round(quantile_cont({v}, {x}), 6) AS {p}{n}" for x, n in ((0.01, "p01"), (0.05, "p05"), (0.5, "median"), (0.95, "p95"), (0.99, "p99")))
    return f"round(CAST(min({v}) AS DOUBLE), 6) AS {p}min, {q}, round(avg({v}), 6) AS {p}mean, round(CAST(max({v}) AS DOUBLE), 6) AS {p}max"


def rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


@query("a4_summary8", FR + f"SELECT label, {_eight('CAST(tcp_length AS DOUBLE)')}, {_eight('CASE WHEN tcp_length > 0 THEN log2(tcp_length) END', 'log_')} FROM frames GROUP BY label")
def a4(spark, d):
    return rounded(A.summary8(V.frames(spark, d), "label", "tcp_length", log2=True), "label")


@query("a5_size_lists", FR + "SELECT flow_id, array_to_string(list(tcp_length ORDER BY frame_number), ',') AS total, coalesce(array_to_string(list(tcp_length ORDER BY frame_number) FILTER (direction > 0), ','), '') AS incoming, coalesce(array_to_string(list(tcp_length ORDER BY frame_number) FILTER (direction < 0), ','), '') AS outgoing FROM frames GROUP BY flow_id")
def a5(spark, d):
    rows = A.size_lists(V.frames(spark, d))
    return rows.select("flow_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("total", "incoming", "outgoing")])


@query("a6_sizes_by_type", RE + f"SELECT flow_id, {NAMES} AS type, direction, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM records GROUP BY ALL")
def a6(spark, d):
    return A.sizes_by_type(V.records(spark, d))


@query("a7_ecdf", FR + "SELECT value, round(sum(n) OVER (ORDER BY value) / sum(n) OVER (), 6) AS share FROM (SELECT tcp_length AS value, count(*) AS n FROM frames GROUP BY value)")
def a7(spark, d):
    return rounded(A.ecdf(V.frames(spark, d), "tcp_length"), "value")


CONV = f""", keyed AS (SELECT *, {KEY} AS key, (ip_src, tcp_srcport) <= (ip_dst, tcp_dstport) AS low FROM packets),
own AS (SELECT *, first_value(low) OVER (PARTITION BY trace_id, key ORDER BY frame_number) AS first_low FROM keyed),
conv AS (SELECT trace_id, key, count(*) FILTER (low = first_low) AS frames_out, coalesce(sum(frame_len) FILTER (low = first_low), 0) AS bytes_out, count(*) FILTER (low <> first_low) AS frames_in, coalesce(sum(frame_len) FILTER (low <> first_low), 0) AS bytes_in, count(*) AS total_frames, sum(frame_len) AS total_bytes, min(time_epoch) AS start, max(time_epoch) - min(time_epoch) AS duration FROM own GROUP BY trace_id, key) """


@query("a8_conversations", PK + CONV + "SELECT trace_id, frames_out, CAST(bytes_out AS BIGINT) AS bytes_out, frames_in, CAST(bytes_in AS BIGINT) AS bytes_in, total_frames, CAST(total_bytes AS BIGINT) AS total_bytes, round(start, 3) AS start, round(duration, 3) AS duration FROM conv")
def a8(spark, d):
    rows = A.conversations(V.packets(spark, d))
    return rows.select("trace_id", "frames_out", "bytes_out", "frames_in", "bytes_in", "total_frames", "total_bytes", F.round("start", 3).alias("start"), F.round("duration", 3).alias("duration"))


@query("a9_trace_rollup", PK + CONV + "SELECT trace_id, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("frames_out", "bytes_out", "frames_in", "bytes_in", "total_frames", "total_bytes")) + ", round(min(start), 3) AS start, round(avg(duration), 3) AS duration FROM conv GROUP BY trace_id")
def a9(spark, d):
    rows = A.trace_rollup(A.conversations(V.packets(spark, d)))
    return rows.withColumns({"start": F.round("start", 3), "duration": F.round("duration", 3)})


@query("a10_observation_space", SY + "SELECT DISTINCT symbol FROM symbols")
def a10(spark, d):
    return A.observation_space(V.seqs(spark, d))


@query("a11_urls_by_host", "SELECT regexp_extract(url, '^https://([^/]*)', 1) AS host, array_to_string(list(page_id ORDER BY page_id), ',') AS ids FROM pages WHERE url LIKE 'https://%' GROUP BY host")
def a11(spark, d):
    u = V.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url").where(F.col("url").startswith("https://"))
    return A.urls_by_host(u, X.hostname(F.col("url"))).select("host", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("a31_label_means", FR + ", per AS (SELECT flow_id, label, count(*) AS frames, avg(tcp_length) AS size FROM frames GROUP BY ALL) SELECT label, round(avg(frames), 6) AS mean_frames, round(stddev_samp(frames), 6) AS std_frames, round(avg(size), 6) AS mean_size, round(stddev_samp(size), 6) AS std_size FROM per GROUP BY label")
def a31(spark, d):
    per = V.frames(spark, d).groupBy("flow_id", "label").agg(F.count("*").alias("frames"), F.avg("tcp_length").alias("size"))
    return rounded(A.label_means(per, ["frames", "size"]), "label")


@query("a37_histogram", FR + ", v AS (SELECT label, CAST(tcp_length AS DOUBLE) AS v FROM frames), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT label, CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n FROM v, e GROUP BY ALL")
def a37(spark, d):
    return A.histogram(V.frames(spark, d), "label", "tcp_length", 20)


@query("a37_log_histogram", FR + ", v AS (SELECT label, ln(CAST(tcp_length AS DOUBLE)) AS v FROM frames WHERE tcp_length > 0), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT label, CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n FROM v, e GROUP BY ALL")
def a37_log(spark, d):
    return A.histogram(V.frames(spark, d), "label", "tcp_length", 20, log=True)


@query("a38_throughput", "SELECT event_type, round(1 / avg(value), 6) AS per_second FROM events GROUP BY event_type")
def a38(spark, d):
    return rounded(A.throughput(V.table(spark, d, "events"), "event_type", "value"), "event_type")


@query("a39_bootstrap_ci")
def a39(spark, d):
    return A.bootstrap_ci(V.frames(spark, d), "label", "tcp_length", b=100)


@query("a39_bootstrap_test")
def a39_test(spark, d):
    return A.bootstrap_test(V.frames(spark, d), "label", "tcp_length", 150.0, b=100)


@query("a39_bootstrap_two_samples")
def a39_two(spark, d):
    """Mean frame sizes of the two directions."""
    f = V.frames(spark, d)
    return A.bootstrap_two_samples(f.where("direction < 0"), f.where("direction > 0"), "label", "tcp_length", b=100)


@query("a39_bootstrap_draws", FR + "SELECT label, CAST(sample AS INT) AS sample, CAST(count(*) AS BIGINT) AS draws FROM frames, range(1, 21) AS r(sample) GROUP BY ALL")
def a39_draws(spark, d):
    """Every resample has as many draws as its key has rows."""
    return A.bootstrap_weights(V.frames(spark, d), "label", "tcp_length", 20, 1).groupBy("label", "sample").agg(F.sum("w").alias("draws"))


# windows


@query("w1_cumulative", FR + "SELECT flow_id, frame_number, CAST(sum(tcp_length) OVER w AS BIGINT) AS total, CAST(sum(tcp_length * direction) OVER w AS BIGINT) AS signed FROM frames WINDOW w AS (PARTITION BY flow_id ORDER BY frame_number)")
def w1(spark, d):
    return W.cumulative(V.frames(spark, d)).select("flow_id", "frame_number", "total", "signed")


RESAMPLED = """, cum AS (SELECT flow_id, frame_number, sum(tcp_length) OVER (PARTITION BY flow_id ORDER BY frame_number) AS v, count(*) OVER (PARTITION BY flow_id) AS n FROM frames),
place AS (SELECT flow_id, i, i * (n - 1) / 9.0 AS x FROM (SELECT DISTINCT flow_id, n FROM cum), range(10) AS r(i)),
pts AS (SELECT a.flow_id, i, l.v * (1 - (x - floor(x))) + coalesce(h.v, l.v) * (x - floor(x)) AS p FROM place a JOIN cum l ON l.flow_id = a.flow_id AND l.frame_number = floor(x) + 1 LEFT JOIN cum h ON h.flow_id = a.flow_id AND h.frame_number = floor(x) + 2) """


@query("w2_resample", FR + RESAMPLED + "SELECT flow_id, CAST(i AS INT) AS i, round(CAST(p AS DOUBLE), 4) AS p FROM pts")
def w2(spark, d):
    rows = W.resample(W.cumulative(V.frames(spark, d)), 10, "total")
    return rows.select("flow_id", F.posexplode("points").alias("i", "p")).withColumn("p", F.round("p", 4))


@query("w3_first_per", PK + "SELECT trace_id, min(frame_number) AS frame_number FROM packets WHERE handshake_type = 1 GROUP BY trace_id")
def w3(spark, d):
    return P.first_per(P.client_hellos(V.packets(spark, d)), ["trace_id"], ["frame_number"]).select("trace_id", "frame_number")


#: Segments with repeats and gaps: a frame's number in its direction is the running sum of sizes; some are sent twice, some lost.
SEG = FR + """, numbered AS (SELECT flow_id, direction, frame_number, tcp_length AS tcp_len, coalesce(CAST(sum(tcp_length) OVER (PARTITION BY flow_id, direction ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS tcp_seq FROM frames WHERE tcp_length > 0),
sent AS (SELECT flow_id, direction, 2 * frame_number AS frame_number, tcp_len, tcp_seq FROM numbered WHERE tcp_len % 11 <> 3 UNION ALL SELECT flow_id, direction, 2 * frame_number + 1, tcp_len, tcp_seq FROM numbered WHERE tcp_len % 11 <> 3 AND tcp_len % 7 = 2),
once AS (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY flow_id, direction, tcp_seq ORDER BY frame_number) = 1),
gaps AS (SELECT *, coalesce(tcp_seq <> lag(tcp_seq + tcp_len) OVER (PARTITION BY flow_id, direction ORDER BY frame_number), false) AS gap FROM once),
whole AS (SELECT * FROM gaps QUALIFY NOT coalesce(bool_or(gap) OVER (PARTITION BY flow_id ORDER BY frame_number), false)) """


def segments(spark, d):
    from pyspark.sql import Window

    before = Window.partitionBy("flow_id", "direction").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = V.frames(spark, d).where("tcp_length > 0").select("flow_id", "direction", "frame_number", F.col("tcp_length").alias("tcp_len"), F.coalesce(F.sum("tcp_length").over(before), F.lit(0)).alias("tcp_seq")).where("tcp_len % 11 <> 3")
    again = F.when(F.col("tcp_len") % 7 == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("r", F.explode(again)).withColumn("frame_number", 2 * F.col("frame_number") + F.col("r")).drop("r")


@query("w4_drop_retransmissions", SEG + "SELECT flow_id, direction, CAST(frame_number AS INT) AS frame_number, tcp_seq FROM once")
def w4(spark, d):
    return W.drop_retransmissions(segments(spark, d)).select("flow_id", "direction", "frame_number", "tcp_seq")


@query("w5_cut_at_gap", SEG + "SELECT flow_id, direction, CAST(frame_number AS INT) AS frame_number, tcp_seq FROM whole")
def w5(spark, d):
    return W.cut_at_gap(W.drop_retransmissions(segments(spark, d))).select("flow_id", "direction", "frame_number", "tcp_seq")


@query("w6_stream_offsets", SEG + "SELECT flow_id, direction, CAST(frame_number AS INT) AS frame_number, CAST(sum(tcp_len) OVER w - tcp_len AS BIGINT) AS lo, CAST(sum(tcp_len) OVER w AS BIGINT) AS hi FROM whole WINDOW w AS (PARTITION BY flow_id, direction ORDER BY frame_number)")
def w6(spark, d):
    return W.stream_offsets(W.cut_at_gap(W.drop_retransmissions(segments(spark, d)))).select("flow_id", "direction", "frame_number", "lo", "hi")


@query("w9_head_elements", FR + "SELECT flow_id, frame_number FROM frames WHERE frame_number <= 5")
def w9(spark, d):
    return W.head_elements(V.frames(spark, d), 5).select("flow_id", "frame_number")


@query("w10_distinct_adjacent", FR + "SELECT flow_id, frame_number, content_type FROM frames QUALIFY frame_number = 1 OR content_type IS DISTINCT FROM lag(content_type) OVER (PARTITION BY flow_id ORDER BY frame_number)")
def w10(spark, d):
    return W.distinct_adjacent(V.frames(spark, d), "flow_id", "frame_number", "content_type").select("flow_id", "frame_number", "content_type")


@query("w11_split", CA + "SELECT u.id, t.tag, CASE WHEN r <= 10 THEN 'test' WHEN r <= 20 THEN 'val' ELSE 'train' END AS dset FROM (SELECT u.id, tag_fk, dense_rank() OVER (PARTITION BY tag_fk ORDER BY md5(u.url), u.url) AS r FROM urls u JOIN tag_assignment ON trace_fk = u.id) u JOIN tags t ON t.id = tag_fk")
def w11(spark, d):
    c = V.catalog(spark, d)
    rows = c["urls"].join(c["tag_assignment"], F.col("id") == F.col("trace_fk")).select("id", "url", "tag_fk").join(c["tags"].withColumnRenamed("id", "tag_fk"), "tag_fk")
    return W.split(rows).select("id", "tag", "dset")


@query("w12_one_unknown_per_day", FR + ", m AS (SELECT DISTINCT flow_id AS id, label, day FROM frames) SELECT id, label, CAST(day AS INT) AS day FROM m QUALIFY label IN ('L0', 'L1') OR row_number() OVER (PARTITION BY day, label ORDER BY id) = 1")
def w12(spark, d):
    m = V.frames(spark, d).select(F.col("flow_id").alias("id"), "label", "day").distinct()
    return W.one_unknown_per_day(m, ["L0", "L1"])


@query("w13_change_points", CA + "SELECT DISTINCT scheduled_date FROM jobs")
def w13(spark, d):
    return W.change_points(V.catalog(spark, d)["jobs"])


@query("w14_day_index", CA + "SELECT id, CAST(dense_rank() OVER (ORDER BY scheduled_date) - 1 AS INT) AS day_index FROM jobs")
def w14(spark, d):
    return W.day_index(V.catalog(spark, d)["jobs"]).select("id", "day_index")


@query("w15_size_sequences", FR + "SELECT flow_id, array_to_string(list(tcp_length * direction ORDER BY frame_number) FILTER (frame_number <= 6), ',') AS sizes FROM frames GROUP BY flow_id")
def w15(spark, d):
    return W.size_sequences(V.frames(spark, d), 6).select("flow_id", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"))


# top-k and sets


@query("t1_order_frames", FR + "SELECT flow_id, frame_number, round(time_epoch, 3) AS time_epoch FROM frames")
def t1(spark, d):
    return P.order_frames(V.frames(spark, d)).select("flow_id", "frame_number", F.round("time_epoch", 3).alias("time_epoch"))


@query("t2_top_k", FR + "SELECT label, flow_id, frame_number, tcp_length FROM frames QUALIFY row_number() OVER (PARTITION BY label ORDER BY tcp_length, flow_id, frame_number) <= 5")
def t2(spark, d):
    return P.top_k(V.frames(spark, d), ["label"], ["tcp_length", "flow_id", "frame_number"], 5).select("label", "flow_id", "frame_number", "tcp_length")


@query("t4_sample_per_label", SQ + " SELECT flow_id, label FROM seqs QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('5:' || flow_id), flow_id) <= 300")
def t4(spark, d):
    return P.sample_per_label(V.seqs(spark, d), 300, 5).select("flow_id", "label")


@query("t5_limit", CA + "SELECT id, filename FROM traces_metadata ORDER BY id LIMIT 100")
def t5(spark, d):
    return P.limit_rows(V.catalog(spark, d)["traces_metadata"].select("id", "filename"), 100, "id")


@query("t6_sample_rows", CA + "SELECT id, filename FROM traces_metadata ORDER BY md5('3:' || id), id LIMIT 50")
def t6(spark, d):
    return P.sample_rows(V.catalog(spark, d)["traces_metadata"], 50, 3, "id").select("id", "filename")


@query("u1_train_plus_val", SQ + "SELECT flow_id, label, dset FROM seqs WHERE dset IN ('train', 'val')")
def u1(spark, d):
    return P.train_plus_val(V.seqs(spark, d)).select("flow_id", "label", "dset")


@query("u2_all_labels", FR + "SELECT DISTINCT label FROM frames")
def u2(spark, d):
    f = V.frames(spark, d)
    return P.all_labels(f.where("label < 'L3'"), f.where("label >= 'L3'"))


@query("u3_common_keys", "SELECT o_orderkey AS flow_id FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def u3(spark, d):
    return P.common_keys(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("flow_id")), V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow_id")))


@query("u4_minus", "SELECT c_custkey AS url FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u4(spark, d):
    return P.minus(V.table(spark, d, "customer").select(F.col("c_custkey").alias("url")), V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("url")))


@query("u5_union_sets", f"WITH {V.RESOLUTIONS} SELECT DISTINCT url_id, ip FROM resolutions")
def u5(spark, d):
    r = V.resolutions(spark, d)
    return P.union_sets(r.where("load % 2 = 0"), r.where("load % 2 = 1"), "url_id", "ip")


# symbols and scalar functions


@query("f1_edges_equal", FR + "SELECT flow_id, frame_number, bin FROM (SELECT flow_id, frame_number, list_position(list_transform(range(10), lambda i: abs(i * 1500.0 / 9 - tcp_length)), list_min(list_transform(range(10), lambda i: abs(i * 1500.0 / 9 - tcp_length)))) - 1 AS bin FROM frames)")
def f1(spark, d):
    return V.frames(spark, d).select("flow_id", "frame_number", S.nearest_edge(F.col("tcp_length"), F.array(*[F.lit(x) for x in S.edges_equal(1500, 10)])).alias("bin"))


@query("f2_edges_log", FR + "SELECT flow_id, frame_number, list_position(ds, list_min(ds)) - 1 AS bin FROM (SELECT flow_id, frame_number, list_transform(range(8), lambda i: abs(exp(i * ln(1500.0) / 7) - tcp_length)) AS ds FROM frames)")
def f2(spark, d):
    return V.frames(spark, d).select("flow_id", "frame_number", S.nearest_edge(F.col("tcp_length"), S.edges_log(1500, 8)).alias("bin"))


@query("f3_edges_frequency", FR + ", s AS (SELECT list(CAST(tcp_length AS DOUBLE) ORDER BY tcp_length) AS l, count(*) AS n FROM frames) SELECT CAST(i AS INT) AS i, round(l[CAST(floor(x) AS INT) + 1] * (1 - (x - floor(x))) + l[CAST(ceil(x) AS INT) + 1] * (x - floor(x)), 6) AS edge FROM (SELECT l, i, least(i * n / 10.0, n - 1) AS x FROM s, range(11) AS r(i))")
def f3(spark, d):
    return S.edges_frequency(V.frames(spark, d), "tcp_length", 10).select(F.posexplode("edges").alias("i", "edge")).withColumn("edge", F.round("edge", 6))


@query("f4_edges_single", FR + "SELECT flow_id, frame_number, 0 AS bin FROM frames")
def f4(spark, d):
    return V.frames(spark, d).select("flow_id", "frame_number", S.nearest_edge(F.col("tcp_length"), S.edges_single()).alias("bin"))


@query("f5_make_edges", FR + ", t AS (SELECT CAST(tcp_length AS DOUBLE) AS v FROM frames WHERE dset = 'train' AND frame_number <= 5), s AS (SELECT list(v ORDER BY v) AS l, count(*) AS n FROM t) SELECT CAST(i AS INT) AS i, round(l[CAST(floor(x) AS INT) + 1] * (1 - (x - floor(x))) + l[CAST(ceil(x) AS INT) + 1] * (x - floor(x)), 6) AS edge FROM (SELECT l, i, least(i * n / 6.0, n - 1) AS x FROM s, range(7) AS r(i))")
def f5(spark, d):
    rows = W.head_elements(V.frames(spark, d).where("dset = 'train'"), 5)
    return S.edges_frequency(rows, "tcp_length", 6).select(F.posexplode("edges").alias("i", "edge")).withColumn("edge", F.round("edge", 6))


@query("f6_nearest_edge", SY + "SELECT flow_id, frame_number, bin FROM symbols")
def f6(spark, d):
    return V.symbols(spark, d).select("flow_id", "frame_number", "bin")


@query("f7_frame_symbol", RE + ", g AS (SELECT flow_id, direction, (record_number - 1) // 2 AS frame, string_agg(content_type || coalesce(':' || handshake_type, ''), '|' ORDER BY record_number) AS types, sum(length) AS size FROM records GROUP BY ALL) SELECT flow_id, CAST(frame AS INT) AS frame, types || ';' || size || ';' || CASE WHEN direction < 0 THEN 'C' ELSE 'S' END AS symbol FROM g")
def f7(spark, d):
    g = V.records(spark, d).groupBy("flow_id", "direction", F.floor((F.col("record_number") - 1) / 2).cast("int").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("record_number", "content_type", "handshake_type"))).alias("records"), F.sum("length").alias("size"))
    return g.select("flow_id", "frame", S.frame_symbol(F.col("direction"), F.col("size"), F.col("records")).alias("symbol"))


@query("f8_record_symbol", SY + "SELECT flow_id, frame_number, symbol FROM symbols")
def f8(spark, d):
    return V.symbols(spark, d).select("flow_id", "frame_number", "symbol")


@query("f9_info_symbols", PK + ", parts AS (SELECT trace_id, frame_number, string_split(info || CASE WHEN frame_number % 3 = 0 THEN ', Alert' ELSE '' END, ',') AS p, tcp_len FROM packets) SELECT trace_id, frame_number, CAST(i AS INT) AS i, CASE trim(p[i + 1]) WHEN 'Client Hello' THEN '1' WHEN 'Application Data' THEN '23' ELSE '0' END || ';' || CAST(floor(tcp_len / len(p)) AS INT) AS symbol FROM parts, range(2) AS r(i) WHERE i < len(p)")
def f9(spark, d):
    info = F.concat(F.col("info"), F.when(F.col("frame_number") % 3 == 0, ", Alert").otherwise(""))
    codes = F.create_map(*[F.lit(x) for x in ("Client Hello", "1", "Application Data", "23")])
    rows = V.packets(spark, d).withColumn("p", F.split(info, ","))
    return rows.select("trace_id", "frame_number", F.posexplode("p").alias("i", "part"), F.floor(F.col("tcp_len") / F.size("p")).alias("size")).select("trace_id", "frame_number", "i", F.concat(F.coalesce(F.try_element_at(codes, F.trim("part")), F.lit("0")), F.lit(";"), F.col("size").cast("string")).alias("symbol"))


@query("f10_pad_and_cut", SQ + "SELECT flow_id, array_to_string(CASE WHEN len(seq) = 1 THEN list_append(seq, '0') ELSE seq[1:4] END, ' ') AS seq FROM seqs")
def f10(spark, d):
    return V.seqs(spark, d).select("flow_id", F.array_join(S.pad_and_cut(F.col("seq"), 4), " ").alias("seq"))


@query("f11_encode", SY + ", vocab AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS id FROM (SELECT DISTINCT symbol FROM symbols WHERE dset = 'train' AND label = 'L1')) SELECT flow_id, string_agg(coalesce(id, -1), ',' ORDER BY frame_number) AS ids FROM symbols LEFT JOIN vocab USING (symbol) GROUP BY flow_id")
def f11(spark, d):
    from flowlab.operators.similarity import encode, vocabulary

    s = V.seqs(spark, d)
    return encode(s, vocabulary(s.where("dset = 'train' and label = 'L1'"))).select("flow_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("f12_edit_distance", SQ + "SELECT a.flow_id, levenshtein(a.word, b.word) AS dist FROM seqs a JOIN seqs b ON b.flow_id = a.flow_id + 1")
def f12(spark, d):
    w = V.words(spark, d)
    b = w.select((F.col("flow_id") - 1).alias("flow_id"), F.col("word").alias("other"))
    return w.join(b, "flow_id").select("flow_id", S.edit_distance(F.col("word"), F.col("other")).cast("long").alias("dist"))


@query("f13_symbol_hash", FR + ", v AS (SELECT flow_id, frame_number, (CASE WHEN direction < 0 THEN 1 ELSE 0 END)::HUGEINT AS a, (tcp_length // 256)::HUGEINT AS b, (tcp_length % 256)::HUGEINT AS c, content_type::HUGEINT AS t FROM frames) SELECT flow_id, frame_number, CAST(((((5381::HUGEINT * 33 + a) * 33 + b) * 33 + c) * 33 + t) % 18446744073709551616 AS VARCHAR) AS h FROM v")
def f13(spark, d):
    h = S.symbol_hash(F.when(F.col("direction") < 0, 1).otherwise(0), F.col("tcp_length"), F.array("content_type"))
    return V.frames(spark, d).select("flow_id", "frame_number", h.cast("string").alias("h"))


@query("f15_normalised", "SELECT event_id, round(abs(ln(value)) / 3, 6) AS ratio, round(ln(value) / (1.1 * 3), 6) AS slack, CAST(ln(value) >= 3 AS INT) AS floor FROM events WHERE value > 0")
def f15(spark, d):
    s, t = F.ln("value"), F.lit(3)
    return V.table(spark, d, "events").where("value > 0").select("event_id", F.round(S.normalised(s, t), 6).alias("ratio"), F.round(S.normalised(s, t, "slack"), 6).alias("slack"), S.normalised(s, t, "floor").alias("floor"))


FLOOR = ", c AS (SELECT label, content_type, CAST(count(*) AS DOUBLE) AS n FROM frames GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS p FROM c), m AS (SELECT *, p < 0.19 AS low FROM s) "


@query("f16_floor_normalise", FR + FLOOR + "SELECT label, content_type, round(CASE WHEN low THEN 0.19 ELSE p / sum(CASE WHEN low THEN 0 ELSE p END) OVER (PARTITION BY label) * (1 - 0.19 * count(*) FILTER (low) OVER (PARTITION BY label)) END, 6) AS p FROM m")
def f16(spark, d):
    return floor_normalise(V.frames(spark, d).groupBy("label", "content_type").agg(F.count("*").cast("double").alias("n")), "label", "n", 0.19).select("label", "content_type", F.round("p", 6).alias("p"))


def floor_normalise(df, key, value, p_min):
    """p: shares of a key with entries below p_min lifted to it, the others scaled so that the sum is 1."""
    from pyspark.sql import Window

    own = Window.partitionBy(key)
    rows = df.withColumn("p", F.col(value) / F.sum(value).over(own)).withColumn("__low", F.col("p") < p_min)
    rest = F.sum(F.when(~F.col("__low"), F.col("p")).otherwise(0.0)).over(own)
    room = 1 - p_min * F.sum(F.col("__low").cast("int")).over(own)
    return rows.withColumn("p", F.when(F.col("__low"), p_min).otherwise(F.col("p") / rest * room)).drop("__low")


@query("f18_run_config", "SELECT event_id, event_type AS model, 'load' || (user_id % 3) AS workload, CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS size, CAST(user_id % 10 AS INT) AS count, CASE WHEN user_id % 2 = 0 THEN 'multi' ELSE 'single' END AS mode FROM events")
def f18(spark, d):
    name = F.concat_ws("-", "event_type", F.concat(F.lit("load"), (F.col("user_id") % 3).cast("string")), F.when(F.col("value") > 50, "big").otherwise("small"), (F.col("user_id") % 10).cast("string"), F.when(F.col("user_id") % 2 == 0, "multi"))
    return V.table(spark, d, "events").select("event_id", X.run_config(name).alias("c")).select("event_id", "c.*")


@query("f19_times", "SELECT event_id, ts + INTERVAL 5 HOURS AS later, date_trunc('milliseconds', ts) AS millis, CAST(epoch_us(ts) AS VARCHAR) AS micros FROM events")
def f19(spark, d):
    e = V.table(spark, d, "events")
    nanos = X.epoch_nanos(F.unix_seconds("ts"), (F.unix_micros("ts") % 1_000_000) * 1000)
    return e.select("event_id", X.shift_hours(F.col("ts"), 5).cast("timestamp_ntz").alias("later"), F.timestamp_millis(F.unix_millis("ts")).cast("timestamp_ntz").alias("millis"), (nanos * 1_000_000).cast("long").cast("string").alias("micros"))


@query("f20_phmm_parameters", "SELECT p_partkey, CAST(3 * (3 * p_size + 1) + 3 + (2 * p_size + 1) * CASE WHEN p_partkey % 3 = 0 THEN 1500 WHEN p_partkey % 3 = 1 THEN 1 ELSE 40 END AS BIGINT) AS n FROM part")
def f20(spark, d):
    m = F.when(F.col("p_partkey") % 3 == 0, "none").when(F.col("p_partkey") % 3 == 1, "single").otherwise("equal")
    return V.table(spark, d, "part").select("p_partkey", X.phmm_parameters(F.col("p_size"), F.lit(40), m).cast("long").alias("n"))


@query("f21_cycles_to_us", "SELECT event_id, round(value * 1e6 / 2.2e9 * 1e6, 6) AS us FROM events")
def f21(spark, d):
    return V.table(spark, d, "events").select("event_id", F.round(X.cycles_to_us(F.col("value") * 1e6), 6).alias("us"))


@query("f22_escape_and_tags", "SELECT p_partkey, replace(p_name, ' ', '%20') AS url, array_to_string(string_split(replace(p_type, ' ', ';'), ';'), ',') AS tags FROM part")
def f22(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", X.escape_spaces(F.col("p_name")).alias("url"), F.array_join(X.split_tags(F.replace("p_type", F.lit(" "), F.lit(";"))), ",").alias("tags"))


@query("f23_flow_json", FR + "SELECT flow_id, count(*) AS frames, CAST(sum(tcp_length) AS BIGINT) AS bytes FROM frames GROUP BY flow_id")
def f23(spark, d):
    """Flows as JSON documents and back."""
    rows = V.frames(spark, d).groupBy("flow_id").agg(F.collect_list(F.struct("tcp_length", "frame_number", "time_epoch", "direction")).alias("frames"))
    back = rows.select("flow_id", X.flow_from_json(X.flow_to_json(F.struct("frames"))).alias("flow"))
    return back.select("flow_id", F.size("flow.frames").cast("long").alias("frames"), F.aggregate("flow.frames", F.lit(0).cast("long"), lambda acc, f: acc + f["tcp_length"]).alias("bytes"))
