"""URL filters: a blocked Bloom filter before an exact join, and host and path rules.

A listing is a table of canonical URLs.  Its blocked Bloom filter (one 256-bit
block for each URL, one bit in each of eight words) has a bounded number of
blocks, so it is broadcast whatever the size of the listing; only pages that pass
it are shuffled, to an exact join that removes false positives.

Null URLs, and URLs without ``://``, have an empty host and path, fit no rule and
are never listed.  Repeated rows give a row each.  Columns named like a result
column are replaced; others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.shared import Carried, cut, quoted

#: Rules become one expression; a longer list belongs in a listing.
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change what a URL shows.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without end slashes, sorted parameters; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    shown = F.concat(
        F.regexp_replace(host(url), r"^www\.|:(80|443)$", ""),
        F.regexp_replace(path(url), "/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )
    return F.when(host(url) != "", shown)


def _looked_up(packed: DataFrame, listing: DataFrame) -> DataFrame:
    """``packed`` with boolean ``listed``: its column ``canonical`` is in ``listing``."""
    entries = cut(listing.select(F.col("canonical").alias("entry")).where("entry is not null").distinct())
    tested = bloom.tested(packed, entries.withColumnRenamed("entry", "canonical"), "canonical", "hit")
    exact = tested.where("hit").drop("hit").join(entries, F.col("canonical") == F.col("entry"), "left")
    found = exact.withColumn("listed", F.col("entry").isNotNull()).drop("entry")
    return tested.where("not hit").drop("hit").withColumn("listed", F.lit(False)).unionByName(found)


def listed(pages: DataFrame, listing: DataFrame, name: str = "listed", url: str = "url") -> DataFrame:
    """Add boolean ``name``: the page's canonical URL is in ``listing`` (its only column used: ``canonical``)."""
    carried = Carried(pages, f"`{name}` boolean", url)
    found = _looked_up(carried.pack(pages, canonical=canonical(quoted(url))), listing)
    return carried.unpack(found.withColumnRenamed("listed", name))


def rule_columns(rules: list[tuple[str, str, str]], host_of: Column, path_of: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest (verdict, host, path) rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in an expression")
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_of == rule_host) | host_of.endswith("." + rule_host)) & path_of.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listing: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``listed`` and ``verdict``: the rule's, else ``block`` if listed."""
    carried = Carried(pages, "host string, path string, rule string, listed boolean, verdict string", url)
    packed = carried.pack(pages, canonical=canonical(quoted(url)), host=host(quoted(url)), path=path(quoted(url)))
    name, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    found = _looked_up(packed, listing)
    return carried.unpack(found.withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))}))
