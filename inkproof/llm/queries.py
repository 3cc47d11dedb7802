"""The registered queries of this subpackage, each over its whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.llm import iceberg_terms, mix_weights, quotes, quotient_dedup, turn_repair
from inkproof.llm.common import table
from inkproof.llm.compression_quality import quality_scores
from inkproof.llm.decision_rules import judge
from inkproof.llm.decontaminate import contamination_report
from inkproof.llm.host_reputation import judge_urls
from inkproof.llm.html_extract import main_texts
from inkproof.llm.near_dedup import near_duplicates
from inkproof.llm.quotient_dedup import exact_duplicates
from inkproof.llm.toxicity import toxicity_scores
from inkproof.llm.warc_index import archive_round_trip


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_weights.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as mail that quotes the two turns before; the conversations are found again from the texts alone."""
    return quotes.conversations(quotes.as_mail(table(spark, sf_dir, "conversations")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages are the quality labels with the page's number: the tables have no others."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").alias("good"))
    return judge_urls(pages, pages.select("page_id", "url").join(labels, "page_id"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iceberg_terms.source_divergence(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (
        op1_warc_index, op2_source_mix, op3_near_dedup, op4_quotation_links, op5_decontaminate, op6_html_main_text,
        op7_compression_quality, op8_quality_rules, op9_host_reputation, op10_toxicity,
        op11_turn_repair, op12_source_divergence, op13_exact_dedup)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Queries 6 to 10 rest on models that SQL cannot fit; tests hold them against brute force and held-out labels.
SQL: dict[str, str] = {
    "op1_warc_index": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS first FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
""",
    "op2_source_mix": mix_weights.SQL,
    "op3_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(a) < 5 THEN array_to_string(a, ' ') ELSE array_to_string(a[i:i + 4], ' ') END AS x
  FROM w, unnest(range(1, greatest(2, len(a) - 3))) AS t(i) WHERE len(a) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, w.doc_id = min(reach.b) AS kept
FROM w JOIN reach ON w.doc_id = reach.a LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
""",
    "op4_quotation_links": quotes.SQL,
    "op11_turn_repair": turn_repair.SQL,
    "op12_source_divergence": iceberg_terms.SQL,
    "op13_exact_dedup": quotient_dedup.SQL,
    "op5_decontaminate": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(a)) AS k, array_to_string(a[i:i + least(13, len(a)) - 1], ' ') AS x
  FROM b, unnest(range(1, greatest(2, len(a) - 11))) AS t(i) WHERE len(a) > 0
), sizes AS (
  SELECT DISTINCT k FROM win
), found AS (
  SELECT g.doc_id, g.i, g.k, item_id
  FROM (SELECT doc_id, i, k, array_to_string(a[i:i + k - 1], ' ') AS x FROM d, sizes, unnest(range(1, greatest(1, len(a) - k + 2))) AS t(i)) g
  JOIN win ON win.k = g.k AND win.x = g.x
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(a) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
