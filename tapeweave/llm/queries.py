"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import corpus_pipeline
from tapeweave.llm import (
    decontaminate, language, licenses, neighbours, packing, preferences, quality, ranked_search, repetition, simhash, spelling,
    token_counts, url_filter,
)
from tapeweave.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}

RULES = (
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def revision(docs: DataFrame):
    """Edits of every document, from its own columns: a cut, the source's name in the middle, a note at the end."""
    n = F.length(F.coalesce("text", F.lit("")))
    cut = F.pmod(F.xxhash64("doc_id"), F.floor(n / 3) + 1)
    middle = F.greatest(cut + 12, F.floor(n / 2))
    note = F.concat(F.lit(" ["), F.coalesce("source", F.lit("")), F.lit("]"))
    parts = ((cut, F.lit(12), F.lit("")), (middle, F.lit(0), note), (F.greatest(n, middle), F.lit(0), F.lit("\nRevised.")))
    edits = [
        F.struct(p.cast("long").alias("position"), d.cast("long").alias("deleted"), t.alias("inserted")) for p, d, t in parts
    ]
    return F.array(*edits)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_counts.counts_with_edits(docs, revision(docs))


_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "op2_url_filter",
    f"""WITH rest AS (SELECT page_id, url, coalesce({_REST}, '') AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_UPPER.lower()}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
canon AS (SELECT page_id, host, path, CASE WHEN strpos(url, '://') > 0 THEN
    regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/$', '') ||
    (SELECT CASE WHEN count(*) = 0 THEN '' ELSE '?' || string_agg(p, '&' ORDER BY p) END
     FROM (SELECT unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) AS p) AS q
     WHERE p <> '' AND NOT regexp_full_match(p, '{url_filter.TRACKING}')) END AS key FROM parts),
shared AS (SELECT key FROM canon WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
rules(rh, rp, rv) AS (VALUES {", ".join(str(r) for r in RULES)}),
fits AS (SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp) AS rn
  FROM (SELECT DISTINCT page_id, host, path FROM canon) c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT c.page_id, host, path, rule,
  coalesce(rv, CASE WHEN s.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, s.key IS NOT NULL AS listed
FROM canon c LEFT JOIN shared s ON s.key = c.key LEFT JOIN fits f ON f.page_id = c.page_id AND rn = 1""",
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.shared_urls(pages), RULES)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # no id: none of a fold
    model = quality.fit(docs, labels, usable=~held_out)
    scored = quality.scores(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, _ = url_filter.host_and_path(F.col("url"))
    return language.identify_pages(read(spark, sf_dir, "pages"), host)


def parroted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen: each conversation up to its last assistant turn. Rejected: there the turn before it is repeated."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    known = turns.withColumn("before", F.lag("text").over(order))
    known = known.withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(whole))
    known = known.where(F.col("last").isNull() | (F.col("turn") <= F.col("last")))
    answer = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant")
    chosen = known.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    text = F.when(answer, F.coalesce("before", F.lit(""))).otherwise(F.col("text"))
    return chosen, known.select(F.col("conv_id").alias("pair_id"), "turn", "role", text.alias("text"))


def _side_sql(name: str, text: str) -> str:
    return f"""{name} AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce({text}, '') AS text FROM known))"""


def _completion_sql(name: str) -> str:
    return f"""{name}_out AS (SELECT conv_id, string_agg(head || body || chr(10), '' ORDER BY i) AS out,
    string_agg(CASE WHEN role = 'assistant' THEN (pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR END, ',' ORDER BY i) AS spans
  FROM (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM (SELECT s.conv_id, i, role, '<|' || replace(role, '<|', '<\\|') || '|>' || chr(10) AS head,
        replace(text, '<|', '<\\|') || '<|end|>' AS body FROM {name} s JOIN cut USING (conv_id) WHERE i > n)) GROUP BY conv_id)"""


@query(
    "op5_preferences",
    f"""WITH known AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS final FROM conversations WHERE conv_id IS NOT NULL)
  WHERE final IS NULL OR turn <= final),
{_side_sql("c", "text")},
{_side_sql("r", "CASE WHEN turn = final AND role = 'assistant' THEN coalesce(prior, '') ELSE text END")},
sizes AS (SELECT conv_id, count(*) AS size FROM c GROUP BY conv_id),
cut AS (SELECT conv_id, coalesce(min(first), max(size)) AS n FROM sizes LEFT JOIN
  (SELECT c.conv_id, c.i - 1 AS first FROM c JOIN r ON c.conv_id = r.conv_id AND c.i = r.i WHERE c.role <> r.role OR c.text <> r.text) d
  USING (conv_id) GROUP BY conv_id),
p_out AS (SELECT conv_id, string_agg('<|' || replace(role, '<|', '<\\|') || '|>' || chr(10) || replace(text, '<|', '<\\|') || '<|end|>' || chr(10), '' ORDER BY i) AS out
  FROM c JOIN cut USING (conv_id) WHERE i <= n GROUP BY conv_id),
{_completion_sql("c")},
{_completion_sql("r")}
SELECT conv_id AS pair_id, n::BIGINT AS n_prompt_turns, coalesce(p_out.out, '') AS prompt,
  coalesce(c_out.out, '') AS chosen, coalesce(c_out.spans, '') AS chosen_spans,
  coalesce(r_out.out, '') AS rejected, coalesce(r_out.spans, '') AS rejected_spans,
  c_out.spans IS NOT NULL AND r_out.spans IS NOT NULL AS usable
FROM cut LEFT JOIN p_out USING (conv_id) LEFT JOIN c_out USING (conv_id) LEFT JOIN r_out USING (conv_id)""",
)
def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.format_pairs(*parroted(read(spark, sf_dir, "conversations")))
    for side in ("chosen_spans", "rejected_spans"):
        out = out.withColumn(side, F.expr(f"array_join(transform({side}, s -> concat(s.start, '-', s.end)), ',')"))
    return out


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def _grams_sql(table: str, key: str) -> str:
    return f"""{table}_w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}),
{table}_g AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM {table}_w)"""


@query(
    "op9_decontamination",
    f"""WITH {_grams_sql("documents", "doc_id")},
{_grams_sql("benchmark", "item_id")},
sizes AS (SELECT item_id, count(*) AS q FROM benchmark_g GROUP BY item_id),
found AS (SELECT doc_id, item_id, count(*) / max(q) AS share FROM documents_g JOIN benchmark_g USING (g) JOIN sizes USING (item_id)
  GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * max(q) - 1e-9)
SELECT d.doc_id, count(item_id) AS n_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS items,
  coalesce(max(share), 0)::DOUBLE AS containment
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.withColumn("items", F.expr("array_join(transform(items, i -> string(i)), ',')"))


@query("op10_neighbours")
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_SPACES = "\\x20\\x09-\\x0D"


@query(
    "op11_repetition",
    f"""WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^{_SPACES}]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACES}]')) AS lines FROM texts),
words AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS p FROM lists),
repeats AS (
  SELECT r, p, g, 1::BIGINT AS l FROM (SELECT r, p, min(p) OVER same AS g, count(*) OVER same AS c FROM words WINDOW same AS (PARTITION BY r, word)) WHERE c > 1
  UNION ALL
  SELECT r, p, g, l + 1 FROM (SELECT a.r, a.p, a.l, min(a.p) OVER same AS g, count(*) OVER same AS c
    FROM repeats a JOIN words w ON w.r = a.r AND w.p = a.p + a.l WINDOW same AS (PARTITION BY a.r, a.g, w.word)) WHERE c > 1),
inside AS (SELECT r, count(DISTINCT q) FILTER (l = {repetition.WINDOW}) AS n_repeat_words,
    count(DISTINCT q) FILTER (l = {repetition.PASSAGE}) AS n_covered
  FROM (SELECT r, l, unnest(range(p, p + l)) AS q FROM repeats WHERE l IN ({repetition.WINDOW}, {repetition.PASSAGE})) GROUP BY r),
longest AS (SELECT r, max(l) AS longest_repeat FROM repeats GROUP BY r),
passages AS (SELECT r, count(*) AS n_passages FROM (SELECT a.r FROM repeats a LEFT JOIN words b ON b.r = a.r AND b.p = a.p - 1
    LEFT JOIN words n ON n.r = a.r AND n.p = a.p + a.l WHERE a.l >= {repetition.PASSAGE} GROUP BY a.r, a.l, a.g
    HAVING count(DISTINCT b.word) + max((b.word IS NULL)::INT) > 1 AND count(DISTINCT n.word) + max((n.word IS NULL)::INT) > 1) GROUP BY r),
figures AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered,
    coalesce(longest_repeat, 0) AS longest_repeat, coalesce(n_passages, 0) AS n_passages
  FROM lists LEFT JOIN inside USING (r) LEFT JOIN longest USING (r) LEFT JOIN passages USING (r)),
judged AS (SELECT *, n_words < {repetition.WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT (base_failed OR n_covered > {repetition.COVERED} * n_words OR longest_repeat > {repetition.LONGEST}) AS kept FROM judged""",
)
def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def mistyped(doc_id: str, word: str) -> str:
    """``word`` as the contract of op12 misspells it: one document in 31 loses a letter of it."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(read(spark, sf_dir, "documents"), alter=mistyped))


def _terms_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"""


@query(
    "op13_ranked_search",
    f"""WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
found AS (SELECT r, term, count(*) AS tf FROM ({_terms_sql("rows", "r")}) GROUP BY r, term),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM found GROUP BY r),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sizes),
wanted AS (SELECT DISTINCT item_id, term FROM ({_terms_sql("benchmark", "item_id")})),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM found GROUP BY term), totals),
scores AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN found USING (term) JOIN sizes USING (r), totals GROUP BY item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores JOIN rows USING (r) WHERE score > 0)
WHERE rank <= 10""",
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
