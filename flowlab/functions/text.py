"""Column expressions on urls, names, times and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlab.schema import CONTENT_TYPES, FLOW, HANDSHAKE_TYPES, TLS_NAMES


def hostname(url: Column, strict: bool = False) -> Column:
    """Text between https:// and the next slash. Other schemes: null, or an error if strict."""
    found = F.regexp_extract(url, "^https://([^/]*)", 1)
    other = F.raise_error(F.concat(F.lit("not an https url: "), url)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(url.startswith("https://"), found).otherwise(other)


def resolver_host(url: Column) -> Column:
    """Host without scheme, path, query or port."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)", 1)


def is_tls(protocol: Column) -> Column:
    return protocol.isin(*TLS_NAMES)


def has_payload(tcp_len: Column) -> Column:
    return tcp_len > 0


def browser_is(col: Column, mode: str) -> Column:
    """mode: any, wget, or other than wget."""
    return {"any": F.lit(True), "wget": col.like("%Wget%"), "other": ~col.like("%Wget%")}[mode]


def signed_size(length: Column, direction: Column) -> Column:
    return length * direction


def record_type_name(content: Column, handshake: Column) -> Column:
    """Name of a record's type; of handshakes their own, unknown ones as encrypted."""
    names = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    shakes = F.create_map(*[F.lit(x) for pair in HANDSHAKE_TYPES.items() for x in pair])
    return F.when(content == 22, F.coalesce(F.try_element_at(shakes, handshake), F.lit("ENCRYPTED_HANDSHAKE_MESSAGE"))).otherwise(F.try_element_at(names, content))


def flow_key(src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """One key for both directions: the two (ip, port) pairs in order."""
    a, b = F.struct(src.alias("ip"), sport.alias("port")), F.struct(dst.alias("ip"), dport.alias("port"))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def shift_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_interval(hours=F.lit(hours))


def epoch_nanos(sec: Column, nsec: Column) -> Column:
    return (sec.cast("decimal(20,9)") + nsec.cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("decimal(20,9)")


def phmm_parameters(length: Column, bins: Column, method: Column) -> Column:
    """Parameters of a profile HMM: transitions and emissions of `bins` symbols (1500 unbinned, 1 for one bin)."""
    used = F.when(method == "none", 1500).when(method == "single", 1).otherwise(bins)
    return 3 * (3 * length + 1) + 3 + (2 * length + 1) * used


def cycles_to_us(cycles: Column, hz: float = 2.2e9) -> Column:
    return cycles / hz * 1e6


def escape_spaces(url: Column) -> Column:
    return F.replace(url, F.lit(" "), F.lit("%20"))


def split_tags(tags: Column) -> Column:
    return F.split(tags, ";")


def run_config(name: Column) -> Column:
    """Parts of a run name model-workload-size-count-mode."""
    parts = F.split(name, "-")
    return F.struct(F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias("workload"), F.get(parts, F.lit(2)).alias("size"), F.get(parts, F.lit(3)).cast("int").alias("count"), F.coalesce(F.get(parts, F.lit(4)), F.lit("single")).alias("mode"))


def flow_to_json(flow: Column) -> Column:
    return F.to_json(flow)


def flow_from_json(text: Column) -> Column:
    return F.from_json(text, FLOW)


def seeded(seed: int, *parts):
    """A digest of a seed and some values, 32 hex digits: an order or a draw that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def chance(seed: int, *parts):
    """A number in [0, 1) from the first eight digits of the digest."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 8), 16, 10).cast("long") / float(1 << 32)
