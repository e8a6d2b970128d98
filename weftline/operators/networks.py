"""Longest-prefix match of IP addresses with a table of networks of any size.

An address is cut to every prefix length that the networks use, and these prefixes are joined with the networks by
equality; the longest that is found counts. There are at most 33 lengths of IPv4 and 129 of IPv6, whatever the number of
networks, and no pair of address and network is compared that doesn't match.

Defined cases: networks are ``address/length`` or a bare address, which is a network of its own; bits behind the length
don't count; of equal networks the first by its text counts; null and unreadable addresses match nothing, null and
unreadable networks are left out; IPv4 and IPv6 never match each other, also where an IPv6 address holds an IPv4 one;
columns of the addresses stay, whatever their names; empty tables match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.urlguard import ipv4_number, ipv6_hex
from weftline.storage import fresh


def address_hex(text: Column) -> Column:
    """8 hex digits of an IPv4 address, 32 of an IPv6 one, null for anything else."""
    return F.coalesce(F.lower(F.lpad(F.hex(ipv4_number(text)), 8, "0")), ipv6_hex(text))


def prefix(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of hex digits, as whole digits and what is left of the next."""
    whole, rest = (length / 4).cast("int"), length % 4
    nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    mask = F.when(rest == 1, 8).when(rest == 2, 12).otherwise(14)
    return F.concat(F.left(digits, whole), F.when(rest > 0, F.lower(F.hex(nibble.bitwiseAND(mask)))).otherwise(""))


def _split(networks: DataFrame, column: str) -> DataFrame:
    """(network, digits, length) of the readable networks."""
    text = F.trim(F.col(column))
    digits = address_hex(F.regexp_replace(text, r"/\d+$", ""))
    length = F.regexp_extract(text, r"/(\d+)$", 1).try_cast("int")
    d = networks.where(F.col(column).isNotNull()).select(F.col(column).alias("network"), digits.alias("digits"), F.when(text.contains("/"), length).otherwise(F.length(digits) * 4).alias("length"))
    return d.where(F.col("digits").isNotNull() & F.col("length").between(0, F.length("digits") * 4))


def longest_match(addresses: DataFrame, networks: DataFrame, address: str = "address", network: str = "network") -> DataFrame:
    """``addresses`` with ``matched``, the text of the longest network that each lies in, or null."""
    known = _split(networks, network).select("network", "length", F.length("digits").alias("width"), prefix(F.col("digits"), F.col("length")).alias("prefix"))
    known = known.groupBy("width", "length", "prefix").agg(F.min("network").alias("network"))
    lengths = known.groupBy("width").agg(F.collect_set("length").alias("lengths"))  # two rows at most
    # An address that many rows have is looked up once.
    text = fresh("text", addresses)
    each = addresses.select(F.col(address).alias("text")).distinct().withColumn("digits", address_hex(F.trim("text"))).where(F.col("digits").isNotNull())
    cut = each.withColumn("width", F.length("digits")).join(F.broadcast(lengths), "width").select("text", "width", "digits", F.explode("lengths").alias("length"))
    hits = cut.withColumn("prefix", prefix(F.col("digits"), F.col("length"))).join(known, ["width", "length", "prefix"])
    best = hits.groupBy("text").agg(F.max_by("network", "length").alias("matched")).withColumnRenamed("text", text)
    return addresses.drop("matched").join(best, F.col(address) == F.col(text), "left").drop(text)


def within(addresses: DataFrame, networks: DataFrame, address: str = "address", network: str = "network") -> DataFrame:
    """The rows whose address lies in any of the networks."""
    return longest_match(addresses, networks, address, network).where(F.col("matched").isNotNull()).drop("matched")
