"""IP-set fingerprints: entropies of domains and addresses, primary and secondary sets, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entropies(resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, entropy), (ip, entropy): minus the log of a domain's share of all (page load, domain) pairs; an
    address has the mean of its domains."""
    pairs = resolutions.where("domain is not null").select("load", "domain").distinct()
    counts = pairs.groupBy("domain").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    domain = counts.join(F.broadcast(total)).select("domain", (-F.ln(F.col("n") / F.col("total"))).alias("entropy"))
    ip = resolutions.select("ip", "domain").distinct().join(domain, "domain").groupBy("ip").agg(F.avg("entropy").alias("entropy"))
    return domain, ip


def ip_sets(resolutions: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, ip) twice: addresses of a label's own host (hosts: url_id, label, host; as many as there are urls, so Spark decides by
    their size how they are joined), and the others seen with its urls."""
    rows = resolutions.join(hosts, "url_id")
    own = F.col("domain") == F.col("host")
    primary = rows.where(own).select("label", "ip").distinct()
    return primary, rows.where(~own).select("label", "ip").distinct().join(primary, ["label", "ip"], "left_anti")


def score_ipset(pages: DataFrame, primary: DataFrame, secondary: DataFrame, entropy: DataFrame) -> DataFrame:
    """(load, label, score) for pages (load, ip, is_primary): labels that share a primary address; the score is the sum of
    the entropies of the shared secondary addresses."""
    candidates = pages.where("is_primary").join(primary, "ip").select("load", "label").distinct()
    others = pages.where("not is_primary").select("load", "ip").distinct().join(secondary, "ip").join(entropy, "ip")
    return candidates.join(others.groupBy("load", "label").agg(F.sum("entropy").alias("score")), ["load", "label"], "left").fillna(0.0, ["score"])


def ipset_classify(scores: DataFrame) -> DataFrame:
    return scores.groupBy("load").agg(F.min_by("label", F.struct((-F.round("score", 9)).alias("s"), "label")).alias("predicted"), F.max("score").alias("score"))
