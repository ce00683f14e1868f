"""URL filters: host and path rules first, a list of canonical URLs for the rest.

The list is looked up through a blocked Bloom filter and an exact join. The filter is a table of
blocks, each eight 64-bit words; a URL sets one bit in every word of one block, and there is a block for
every 32 listed URLs. Up to ``BROADCAST_BLOCKS`` the filter is broadcast, a larger one is joined by block.
Pages whose bits are all set are possible hits and meet the list in a hash join on the canonical URL; all
others are let through where they are, and so the pages are read once for each of the two ways.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.runtime import durable

#: (verdict, host, path). Fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS_PER_BLOCK = 32
#: 72 bytes each, 38 MB in all.
BROADCAST_BLOCKS = 1 << 19
WORDS = 8
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling of a page's address; null where there is no host.

    Without scheme, fragment, ``www.`` and ``m.``, closing slashes, and ``utm_`` and ``ref`` parameters;
    the other parameters in order.
    """
    host = F.regexp_replace(host_of(url), "^(www|m)\\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(after_scheme(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref=")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        name, verdict = F.when(fits, F.lit(of_host + of_path)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def blocks_for(urls: int) -> int:
    """Blocks of a filter for a list of that size."""
    return max(-(-urls // URLS_PER_BLOCK), 1)


def _bits(url: str, blocks: int) -> tuple[Column, list[Column]]:
    first = F.xxhash64(url)
    second = F.xxhash64(F.lit(7), F.col(url))
    block = F.pmod(first, F.lit(blocks)).cast("int")
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom(listed: DataFrame, blocks: int, url: str = "canonical") -> DataFrame:
    """Blocked Bloom filter: ``block`` and words ``w0`` to ``w7``; ``blocks`` rows at most."""
    block, bits = _bits(url, blocks)
    rows = listed.where(F.col(url).isNotNull()).select(block.alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``row`` (all columns of ``pages``), ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    ``listed`` has a column ``url``. Without a rule, listed pages are blocked and others allowed. Null urls
    and urls without ``://`` have empty host and path and are allowed. Repeated pages and list
    entries change nothing; an empty list blocks nothing. The list's canonical addresses are written once,
    since their number decides the size of the filter.
    """
    address = F.col("row").getField(url)
    host, path = host_of(address), path_of(address)
    known = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")).select("row", host.alias("host"), path.alias("path"), canonical(address).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = known.withColumn("rule", rule).withColumn("verdict", verdict)
    entries = durable(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct(), "listed-urls")
    blocks = blocks_for(entries.count())
    block, bits = _bits("canonical", blocks)
    table = bloom(entries, blocks)
    possible = F.lit(True)
    for k, bit in enumerate(bits):
        possible = possible & (F.coalesce(F.col(f"w{k}"), F.lit(0)).bitwiseAND(bit) != 0)
    open_ = F.col("rule").isNull() & F.col("canonical").isNotNull()
    probed = known.withColumn("block", F.when(open_, block)).join(F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table, "block", "left").withColumn("possible", open_ & possible)
    out = ["row", "host", "path", "rule"]
    passed = probed.where(~F.col("possible")).select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    hits = (
        probed.where("possible")
        .join(entries.withColumn("hit", F.lit(True)), "canonical", "left")
        .select(*out, F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    )
    return passed.unionByName(hits)
