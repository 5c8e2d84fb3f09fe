import pytest
from pyspark.sql import functions as F

from tapeweave.llm import url_filter

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"))
URLS = [
    ("http://A.example.COM/en/7x?b=2&a=1#top", "a.example.com", "/en/7x", "example.com/en/7", "a.example.com/en/7x?a=1&b=2"),
    ("https://www.shop.com:443/en/1/?utm_source=x&ref=y", "www.shop.com:443", "/en/1/", None, "shop.com/en/1"),
    ("https://shop.com/en/1", "shop.com", "/en/1", "com/en/", "shop.com/en/1"),
    ("ftp://notcom/en/", "notcom", "/en/", None, "notcom/en"),
    ("no scheme at all/en/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("://", "", "", None, ""),
    ("x://h?q=1://u", "h", "", None, "h?q=1://u"),
    ("x://É.com", "É.com", "", None, "É.com"),
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "k", "w") for i, u in enumerate(urls)], "page_id long, url string, key string, w0 string")


def test_parts_rules_and_canonical_forms(spark):
    table = pages(spark, [u[0] for u in URLS])
    listed = spark.createDataFrame([("shop.com/en/1",), ("unseen",), (None,), ("shop.com/en/1",)], "canonical string")
    rows = {r.page_id: r for r in url_filter.judge(table, listed, RULES).collect()}
    keys = {r.page_id: r.c for r in table.select("page_id", url_filter.canonical(F.col("url")).alias("c")).collect()}
    for i, (_, host, path, rule, key) in enumerate(URLS):
        assert (rows[i].host, rows[i].path, rows[i].rule, keys[i]) == (host, path, rule, key), URLS[i]
        assert rows[i].listed == (key == "shop.com/en/1")
        ruled = {"example.com/en/7": "allow", "com/en/": "block"}.get(rule)
        assert rows[i].verdict == (ruled or ("block" if rows[i].listed else "allow"))


@pytest.mark.parametrize("blocks", [1, 4, None])
def test_filter_has_no_false_negatives_and_the_join_no_false_positives(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)  # far too small: most URLs pass the filter
    table = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id")).alias("url"))
    listed = spark.range(0, 6000, 3).select(F.concat(F.lit("h.org/"), F.col("id")).alias("canonical"))
    rows = url_filter.judge(table, listed).collect()
    assert len(rows) == 4000 and all(r.listed == (r.page_id % 3 == 0) for r in rows)


def test_filter_refuses_most_strangers(spark):
    listed = spark.range(2000).select(F.concat(F.lit("in/"), F.col("id")).alias("key"))
    blocks = url_filter.block_count(2000)
    table = url_filter.bloom_blocks(listed, "key", blocks)
    assert table.count() <= blocks == 64
    probe = spark.range(5000).select(F.concat(F.lit("out/"), F.col("id")).alias("key"))
    spots = probe.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(url_filter._bits(F.col("key")))])
    hit = " AND ".join(f"(w{i} & shiftleft(1L, b{i})) <> 0" for i in range(8))
    assert spots.join(table, "block").where(hit).count() < 250


def test_hot_urls_repeats_and_empty_tables(spark):
    table = pages(spark, ["http://hot.org/x"] * 500 + ["http://cold.org/y"])
    shared = url_filter.shared_urls(table)
    assert [r.canonical for r in shared.collect()] == ["hot.org/x"]
    assert sum(r.listed for r in url_filter.judge(table, shared).collect()) == 500
    assert url_filter.judge(table.where("false"), shared).collect() == []
    assert not any(r.listed for r in url_filter.judge(table, shared.where("false")).collect())
