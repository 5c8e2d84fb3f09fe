"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a row are added as log-probabilities: the text under each language's
character-trigram model, the language that its markup declares, the suffix of its address, and the
prior of its host. Everything is counted over all rows by grouped aggregation:

1. trigrams per declared language, hashed to ``BUCKETS`` buckets, give the text models
   (declarations are wrong now and then, which a count over all rows bears);
2. each row's text log-likelihoods give its likeliest language by text;
3. counts of declaration, suffix, host and domain against that language give the other evidence.
   Host priors are smoothed by the domain's, those by the suffix's, those by the language shares.
   A row's own language is taken out of the counts that it is judged by.

The log-likelihood is scaled down to ``TEXT_WEIGHT`` trigrams at most, as trigrams overlap and are
not independent. A row is rejected when its text has no letters that a model could know, or when
the likeliest language stays under ``ACCEPT``.

Tables that reach the driver are bounded: one count per language and bucket. Host counts stay
tables and are joined by host.

Defined results: null texts count as empty; an empty text has only the other evidence and is
rejected; an unknown, null or blank declaration, host or suffix is no evidence; repeated rows
count as often as they come; an empty table gives no rows; without any declaration all languages
are equally likely; ties go to the first language in alphabetical order; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapeweave.llm.common import cut_lineage, drop_ids, field_sql, text_or_empty

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 14
TEXT_WEIGHT = 60.0
KEPT = 4.0  # weight of the wider prior, in rows
ACCEPT = 0.5
SLICE = 1 << 20  # characters handled at a time


def trigrams(text: str):
    """Bucket counts of the trigrams of the lower-cased letters, runs of other characters as one space."""
    text, total = f" {text} ", np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE + 2].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = (codes >= 97) & (codes <= 122) | (codes >= 170) & (codes != 215) & (codes != 247)
        codes = np.where(letter, codes, 32).astype(np.uint64)
        codes = codes[(codes != 32) | np.r_[True, codes[:-1] != 32]]
        if len(codes) < 3:
            continue  # no letter
        with np.errstate(over="ignore"):
            h = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
            h = (h ^ (h >> np.uint64(15))) * np.uint64(0xC2B2AE3D)
        total += np.bincount((h >> np.uint64(8)) % np.uint64(BUCKETS), minlength=BUCKETS)
    return total


def _evidence(rows: DataFrame, id_col, text_col, declared: Column, host: Column) -> DataFrame:
    blank = lambda c: F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit(""))
    known = F.when(blank(declared).rlike("^[a-z]{2,3}$"), blank(declared)).otherwise("")
    return rows.select(
        F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"), known.alias("declared"), blank(host).alias("host")
    )


def trigram_counts(rows: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(language, bucket, n) over all rows with a known declaration; at most one row per language and bucket and task."""
    order = {x: i for i, x in enumerate(languages)}

    def run(batches):
        total = np.zeros((len(order), BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, declared in zip(batch.column("text"), batch.column("declared").to_pylist()):
                if declared in order:
                    total[order[declared]] += trigrams(text.as_py())
        who, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(who.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[who, bucket])],
            names=["language", "bucket", "n"],
        )

    counted = rows.select("text", "declared").mapInArrow(run, "language int, bucket int, n long")
    return counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def text_model(rows: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log-probability of every bucket (rows) under every language (columns)."""
    table = trigram_counts(rows, languages).toArrow()  # bound: languages * BUCKETS rows
    total = np.full((BUCKETS, len(languages)), 0.5)
    np.add.at(total, (table.column("bucket").to_numpy(), table.column("language").to_numpy()), table.column("n").to_numpy())
    return np.log(total / total.sum(axis=0))


@lru_cache(maxsize=1)
def _logs(raw: bytes, languages: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(BUCKETS, languages)


def text_likelihoods(rows: DataFrame, model: np.ndarray, id_field: T.StructField) -> DataFrame:
    """(key, declared, host, n, logs): scaled log-likelihoods per language, n trigrams."""
    raw, width = model.tobytes(), model.shape[1]
    names = ["key", "declared", "host"]
    schema = T.StructType(
        [T.StructField("key", id_field.dataType)] + [T.StructField(n, T.StringType()) for n in names[1:]]
        + [T.StructField("n", T.LongType()), T.StructField("logs", T.ArrayType(T.DoubleType()))]
    )

    def run(batches):
        logs = _logs(raw, width)
        for batch in batches:
            sums, sizes = [], []
            for text in batch.column("text"):
                found = trigrams(text.as_py())
                at = np.flatnonzero(found)
                n = int(found.sum())
                sums.append(found[at] @ logs[at] * (min(n, TEXT_WEIGHT) / n) if n else np.zeros(width))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(sizes, type=pa.int64()), pa.array([s.tolist() for s in sums], type=pa.list_(pa.float64()))],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def _tally(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """Per key: its rows by language of the text, as columns n0, n1, ..."""
    sums = [F.sum(F.when(F.col("by_text") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(width)]
    return rows.groupBy(*keys).agg(*sums)


def _packed(tally: DataFrame, key: str, name: str, width: int) -> DataFrame:
    return tally.select(F.col(key).alias("__key"), F.array(*[f"n{i}" for i in range(width)]).alias(name))


def host_counts(told: DataFrame, width: int) -> DataFrame:
    """(__host, by_host, by_domain, by_suffix): one row per host, with the counts of its domain and suffix.

    The domain is the last two labels of the host, the suffix the last one; a host without a dot has neither.
    """
    dotted = F.col("host").contains(".")
    hosts = _tally(told.where("host <> ''"), width, "host")
    hosts = hosts.withColumn("domain", F.when(dotted, F.substring_index("host", ".", -2)))
    hosts = hosts.withColumn("suffix", F.when(dotted, F.substring_index("host", ".", -1)))
    out = hosts.select("host", "domain", "suffix", F.array(*[f"n{i}" for i in range(width)]).alias("by_host"))
    for key in ("domain", "suffix"):
        wider = hosts.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(width)])
        out = out.join(_packed(wider, key, f"by_{key}", width), F.col(key) == F.col("__key"), "left").drop("__key")
    return out.select(F.col("host").alias("__host"), "by_host", "by_domain", "by_suffix")


def identify(
    rows: DataFrame, declared: Column, host: Column, id_col: str = "doc_id", text_col: str = "text",
    languages: Sequence[str] = LANGUAGES,
) -> DataFrame:
    """Per row: doc_id, language, probability, text_language, rejected."""
    languages = sorted(languages)
    width = len(languages)
    seen = _evidence(rows, id_col, text_col, declared, host)
    scored = text_likelihoods(seen, text_model(seen, languages), field_sql(rows, id_col))
    best = F.expr("CASE WHEN n > 0 THEN array_position(logs, array_max(logs)) - 1 ELSE -1 END")
    scored = cut_lineage(scored.withColumn("by_text", best.cast("int")))
    told = scored.where("by_text >= 0")
    everywhere = _tally(told, width).first()
    shares = [(everywhere[f"n{i}"] or 0) + 1.0 for i in range(width)]
    general = F.array(*[F.lit(s / sum(shares)) for s in shares])

    # bound: a declaration is two or three of 26 letters
    marks = _packed(_tally(told.where("declared <> ''"), width, "declared"), "declared", "by_declared", width)
    scored = scored.join(F.broadcast(marks), F.col("declared") == F.col("__key"), "left").drop("__key")
    # written first, so that a hot host's rows can be split at the join
    hosts = cut_lineage(host_counts(told, width))
    scored = scored.join(hosts, F.col("host") == F.col("__host"), "left").drop("__host")

    zeros = F.array(*[F.lit(0).cast("long")] * width)

    def smoothed(counts: str, wider: Column) -> Column:
        """Shares of the languages in ``counts`` without the row itself, drawn towards ``wider``."""
        others = F.transform(F.coalesce(F.col(counts), zeros), lambda n, i: F.greatest(n - F.when(i == F.col("by_text"), 1).otherwise(0), F.lit(0)))
        pairs = F.zip_with(others, wider, lambda n, w: n + KEPT * w)
        return F.transform(pairs, lambda x: x / F.aggregate(pairs, F.lit(0.0), lambda a, y: a + y))

    for name, counts, wider in (
        ("wide", "by_suffix", general), ("middle", "by_domain", F.col("wide")),
        ("prior", "by_host", F.col("middle")), ("given", "by_declared", general),
    ):
        scored = scored.withColumn(name, smoothed(counts, wider))
    # P(declared | language) up to a factor common to all languages is P(language | declared) / P(language)
    fused = F.transform(
        F.arrays_zip("logs", "prior", "given", general.alias("share")),
        lambda x: x["logs"] + F.log(x["prior"]) + F.log(x["given"]) - F.log(x["share"]),
    )
    scored = scored.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    mass = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in languages])
    out = scored.select(
        F.col("key").alias("doc_id"),
        F.element_at(names, F.array_position("fused", F.col("top")).cast("int")).alias("language"),
        (1 / mass).alias("probability"),
        F.when(F.col("by_text") >= 0, F.element_at(names, F.col("by_text") + 1)).alias("text_language"),
        F.col("n"),
    )
    rejected = (F.col("n") == 0) | (F.col("probability") < ACCEPT)
    return out.select("doc_id", "language", "probability", "text_language", rejected.alias("rejected"))


#: What a reader does not see in a page.
HIDDEN = r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def page_text(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")


def declared_language(html: Column) -> Column:
    """The primary subtag that the page's root element declares."""
    return F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1)


def identify_pages(pages: DataFrame, host: Column, id_col: str = "page_id", html_col: str = "html", **options) -> DataFrame:
    """Pages with their markup, host and address suffix as evidence."""
    html = F.col(html_col).cast("string")
    read = pages.select(
        F.col(id_col).alias("doc_id"), page_text(html).alias("text"), declared_language(html).alias("declared"), host.alias("host")
    )
    return identify(read, F.col("declared"), F.col("host"), **options).withColumnRenamed("doc_id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, whose language is found; ``lang`` is what is declared, ``source`` the host."""
    found = identify(docs, F.col("lang"), F.col("source"), id_col, text_col, **options)
    return drop_ids(docs, found.where("rejected").select(F.col("doc_id").alias(id_col)), id_col)
