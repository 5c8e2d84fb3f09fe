"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks, eight 64-bit words each, built by a grouped bitwise OR; a
URL picks its block and one bit per word by two hashes. It has at most ``MAX_BLOCKS`` blocks, so
it can be broadcast whatever the length of the list: a longer list only lets more URLs through to
the exact join, which decides. URLs that the filter refuses never reach that join.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and no
canonical form, and is allowed; hosts and rules compare as written, ports included; of two
fitting rules of equal length the smaller string wins; repeated rows are judged as often as they
come; an empty table or list gives no rows or no blocks; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tapeweave.llm.common import ascii_lower, cut_lineage

WORDS = 8
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 16  # 4 MB of bits

#: Query parameters that do not name another page.
TRACKING = "(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default ports, path without a last slash, sorted parameters without tracking."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$"))
    tail = F.array_join(F.sort_array(kept), "&")
    return F.when(
        F.instr(url, "://") > 0,
        F.concat(host, F.regexp_replace(path, "/$", ""), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")),
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = []
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*found, nothing)


def _bits(key: Column) -> list[Column]:
    spots = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(spots, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of the keys in ``listed``."""
    spots = listed.select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col(key)))]
    )
    return spots.groupBy("block").agg(*[F.expr(f"bit_or(shiftleft(1L, b{i}))").alias(f"w{i}") for i in range(WORDS)])


def block_count(urls: int) -> int:
    """Blocks for a list of ``urls``: a power of two, at most ``MAX_BLOCKS``."""
    need = max(1, -(-urls * BITS_PER_URL // (64 * WORDS)))
    return min(MAX_BLOCKS, 1 << (need - 1).bit_length())


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    key: str = "canonical",
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, listed. ``listed`` holds canonical URLs under ``key``."""
    keys = cut_lineage(listed.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct())
    blocks = block_count(keys.count())
    table = bloom_blocks(keys, "key", blocks).withColumnRenamed("block", "__block")
    url = F.col("url")
    host, path = host_and_path(url)
    seen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    seen = seen.select("page_id", host.alias("host"), path.alias("path"), canonical(url).alias("key"))
    seen = seen.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    # size bound: MAX_BLOCKS rows of nine longs
    probed = seen.join(F.broadcast(table), F.pmod(F.xxhash64("key"), F.lit(blocks)) == F.col("__block"), "left")
    hit = F.lit(True)
    for i, spot in enumerate(_bits(F.col("key"))):
        hit &= F.col(f"w{i}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), spot)) != 0
    probed = probed.select("page_id", "host", "path", "key", "fit", F.coalesce(hit & F.col("key").isNotNull(), F.lit(False)).alias("maybe"))
    sure = probed.where("NOT maybe").withColumn("listed", F.lit(False))
    exact = probed.where("maybe").join(
        keys.withColumn("__listed", F.lit(True)).hint("shuffle_hash"), "key", "left"
    ).withColumn("listed", F.coalesce("__listed", F.lit(False)))
    both = sure.unionByName(exact.drop("__listed"))
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed")


def shared_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URLs that more than one page gives."""
    keys = pages.select(canonical(F.col(url_col).cast("string")).alias("canonical")).where("canonical IS NOT NULL")
    return keys.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("canonical")
