"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recolta.llm import bpe, contamination, format_copies, langid, pii, residue, stuffing, varied_subset, visual_form
from recolta.session import materialize
from recolta.sources.tables import table


#: Keys that the subset query chooses.
SUBSET_SIZE = 1000


def p1_subset(spark: SparkSession, d: str) -> DataFrame:
    return varied_subset.choose(table(spark, d, "feed_items"), "id", ["cluster_id", "semantic_group", "platform"], SUBSET_SIZE, "score")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.lookalike_pairs(table(spark, d, "items"), "id", ["text_content", "author"])


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.visual_forms(table(spark, d, "items"), "id", ["text_content", "author"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "items"), "id", "text_content")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items")
    return residue.scored(items, "id", "text_content", residue.train(items, "text_content"))


COPY_FIELDS = {"url": "url", "dedupe_key": "key"}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.copies(table(spark, d, "items"), "id", COPY_FIELDS)


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.records(table(spark, d, "items"), "id", COPY_FIELDS)


PII_FIELDS = ["text_content", "image_captions"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.findings(table(spark, d, "items"), "id", PII_FIELDS).filter(F.col("pii_type").isin("email", "phone", "id_number", "address", "name"))
    return found.select("id", "field", "pii_type").distinct()


def p6_findings(spark: SparkSession, d: str) -> DataFrame:
    return pii.findings(table(spark, d, "items"), "id", PII_FIELDS)


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "items"), "id", PII_FIELDS)


def _language_model(items: DataFrame) -> langid.Model:
    return langid.train(items, "text_content", "lang", residue.train(items, "text_content"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items")
    every = materialize(langid.worded(items, "id", "text_content", "lang"), "langid-texts")
    words = materialize(langid.without_residue(every, "id", residue.train_marked(every, "_marked")), "langid-words-of-texts")
    return langid.mislabelled_worded(words, "id", langid.train_worded(words)).select("id", "lang").distinct()


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items")
    return langid.languages(items, "id", "text_content", _language_model(items))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items")
    return langid.language_segments(items, "id", "text_content", _language_model(items))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return contamination.cleaned(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(table(spark, d, "documents"), "doc_id", "text")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.judged(table(spark, d, "documents"), "doc_id", "text").drop("h")


_SKIPPED = r"[\s\p{P}$+<=>^`|~]"
_P5 = f"""
WITH l AS (SELECT id, lower(url) AS u, lower(dedupe_key) AS k FROM items),
c AS (SELECT id,
  regexp_replace(split_part(u, '?', 1), '{_SKIPPED}', '', 'g') AS head,
  list_sort(list_filter(list_transform(regexp_split_to_array(CASE WHEN strpos(u, '?') > 0 THEN substr(u, strpos(u, '?') + 1) ELSE '' END, '[&;#]'), lambda x: regexp_replace(x, '{_SKIPPED}', '', 'g')), lambda x: x <> '')) AS params,
  list_sort(list_filter(list_transform(CASE WHEN strpos(k, '=') > 0 THEN regexp_split_to_array(k, '[;&|,\n\r]') ELSE [k] END, lambda x: regexp_replace(x, '{_SKIPPED}', '', 'g')), lambda x: x <> '')) AS parts
  FROM l WHERE u IS NOT NULL AND k IS NOT NULL),
g AS (SELECT min(id) OVER (PARTITION BY head, params, parts) AS first_id, id FROM c)
"""

_bin = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE '+' || lower(trim({c})) END"
_P1 = f"""
WITH b AS (SELECT id, coalesce(score, '-inf'::DOUBLE) AS s, {_bin("cluster_id")} AS a0, {_bin("semantic_group")} AS a1, {_bin("platform")} AS a2, ('0x' || substr(md5(id), 1, 15))::BIGINT AS h FROM feed_items WHERE id IS NOT NULL),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, a0 DESC, a1 DESC, a2 DESC) = 1),
w0 AS (SELECT *, row_number() OVER (PARTITION BY a0, a1, a2 ORDER BY h, id) AS r0 FROM o),
w1 AS (SELECT *, row_number() OVER (PARTITION BY a0, r0 ORDER BY h, id) AS r1 FROM w0),
w2 AS (SELECT *, row_number() OVER (PARTITION BY a1, r0, r1 ORDER BY h, id) AS r2 FROM w1),
w3 AS (SELECT *, row_number() OVER (PARTITION BY a2, r0 ORDER BY r1, r2, h, id) AS r3 FROM w2)
SELECT id, r0 AS turn FROM w3 ORDER BY r0, r1, r2, r3, a2, h, id LIMIT {SUBSET_SIZE}
"""

QUERIES = {"p1_subset": p1_subset, "p2_found": p2_found, "p2_forms": p2_forms, "p4_found": p4_found, "p4_scores": p4_scores, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_findings": p6_findings, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_languages": p7_languages, "p7_segments": p7_segments, "p8_ids": p8_ids, "p9_found": p9_found, "p9_cleaned": p9_cleaned, "p10_found": p10_found, "p10_scores": p10_scores}
SQL: dict[str, str] = {
    "p1_subset": _P1,
    "p5_found": _P5 + "SELECT DISTINCT first_id, id FROM g WHERE id <> first_id",
    "p5_records": _P5 + "SELECT coalesce(g.first_id, i.id) AS id, count(*) AS copies FROM items i LEFT JOIN g USING (id) GROUP BY 1",
}
