"""URL guards: schemes, blocked host names and addresses in private ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import bound
from weftline.storage import fresh

# Networks and host names that must not be fetched.
BLOCKED_NETWORKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "::1/128", "fc00::/7", "fe80::/10",
    "::ffff:127.0.0.0/104", "::ffff:10.0.0.0/104", "::ffff:172.16.0.0/108", "::ffff:192.168.0.0/112", "::ffff:169.254.0.0/112",
)
BLOCKED_HOSTS = ("metadata.google.internal", "metadata.google.com")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    """Host with port, lower case not forced."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host name in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def is_external(url: Column, base: Column) -> Column:
    return (netloc(url) != netloc(base)) & (netloc(url) != "")


_FOUR = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    number = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda sum_, x: sum_ * 256 + x.cast("long"))
    return F.when(text.rlike(_FOUR), number(F.split(text, r"\.")))


def ipv6_hex(text: Column) -> Column:
    """An IPv6 address as 32 hex digits, which order as the addresses do; null for anything else."""
    # A dotted end becomes two groups.
    tail = r"([0-9.]+)$"
    groups = lambda n: F.concat(F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536)))
    plain = lambda low: F.when(low.contains("."), F.concat(F.regexp_replace(low, tail, ""), bound(ipv4_number(F.regexp_extract(low, tail, 1)), groups))).otherwise(low)
    parted = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    sides = lambda halves: F.struct(parted(F.get(halves, F.lit(0))).alias("left"), parted(F.get(halves, F.lit(1))).alias("right"), F.size(halves).alias("n"))
    zeros = lambda x: F.when(x["n"] == 2, F.array_repeat(F.lit("0"), 8 - F.size(x["left"]) - F.size(x["right"]))).otherwise(F.array().cast("array<string>"))
    filled = lambda x: F.when(x["n"] <= 2, F.concat(x["left"], zeros(x), x["right"]))
    digits = lambda all_: F.when((F.size(all_) == 8) & F.forall(all_, lambda x: x.rlike(r"^[0-9a-f]{1,4}$")), F.array_join(F.transform(all_, lambda x: F.lpad(x, 4, "0")), ""))
    whole = lambda low: bound(bound(F.split(low, "::"), sides), lambda x: bound(filled(x), digits))
    return F.when(text.contains(":"), bound(bound(F.lower(text), plain), whole))


def blocked(addresses: DataFrame, column: str, into: str = "blocked") -> DataFrame:
    """``addresses`` with the boolean ``into``: whether the address lies in a blocked range. The ranges are a fixed list, so the
    range join is a predicate over the address as a number or as hex digits, which are computed once."""
    networks = [(n.version, int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.ip_network, BLOCKED_NETWORKS)]

    def within(value: Column, version: int) -> Column:
        found = F.lit(False)
        for low, high in [(low, high) for v, low, high in networks if v == version]:
            found = found | (value.between(low, high) if version == 4 else value.between(f"{low:032x}", f"{high:032x}"))
        return F.coalesce(found, F.lit(False))

    four, six = bound(ipv4_number(F.col(column)), lambda x: within(x, 4)), bound(ipv6_hex(F.col(column)), lambda x: within(x, 6))
    return addresses.withColumn(into, F.when(F.coalesce(F.col(column).contains(":"), F.lit(False)), six).otherwise(four))


def check(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """urls (url) with ``verdict``: ok, INVALID_URL or SSRF_BLOCKED, by resolved (host, address), a name's addresses."""
    name, hit, literal, bad_literal = (fresh(c, urls) for c in ("guard_host", "guard_hit", "guard_literal", "guard_blocked"))
    bad = blocked(resolved.select("host", "address"), "address").where("blocked").select(F.col("host").alias(hit)).distinct()
    d = urls.withColumn(name, host(F.col("url"))).join(bad, F.col(name) == F.col(hit), "left").withColumn(literal, F.regexp_replace(name, r"^\[|\]$", ""))
    d = blocked(d, literal, bad_literal)
    verdict = F.when(~scheme(F.col("url")).isin("http", "https") | (F.col(name) == ""), "INVALID_URL").when(F.col(name).isin(*BLOCKED_HOSTS) | F.col(hit).isNotNull() | F.col(bad_literal), "SSRF_BLOCKED").otherwise("ok")
    return d.select(*[c for c in urls.columns if c not in ("verdict", "host")], F.col(name).alias("host"), verdict.alias("verdict"))
