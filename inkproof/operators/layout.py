"""Layout statistics of documents from span, line and page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions.text import strip


def variance(value: Column) -> Column:
    """Population variance to four digits, zero below two values."""
    return F.when(F.count(value) > 1, F.round(F.var_pop(value), 4)).otherwise(F.lit(0.0))


def font_variance(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(variance(F.col("font_size")).alias("font_size_variance"))


def line_offset_variance(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(variance(F.col("x0")).alias("alignment_variance"))


def document_stats(pages: DataFrame) -> DataFrame:
    """Page rows (doc_id, page_no, text, ocr_used, ocr_confidence) to one row per document.

    Only counts and sums are shuffled.  The joined text has one separator of two line feeds
    between consecutive pages.
    """
    text = F.col("text")
    per_page = pages.select(
        "doc_id",
        F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")).alias("words"),
        F.length(text).alias("chars"),
        (F.length(strip(text)) == 0).cast("int").alias("blank"),
        F.col("ocr_used").cast("int").alias("ocr"),
        # decimal sums do not depend on the order rows arrive in
        F.when(F.col("ocr_used"), F.col("ocr_confidence").cast("decimal(12,6)")).alias("confidence"),
    )
    return per_page.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("words").alias("words"),
        (F.sum("chars") + 2 * (F.count(F.lit(1)) - 1)).alias("characters"),
        F.sum("blank").alias("blank_page_count"),
        F.sum("ocr").alias("ocr_pages"),
        F.round(F.coalesce(F.avg("confidence").cast("double"), F.lit(0.0)), 2).alias("ocr_confidence"),
    )


def joined_text(pages: DataFrame, bucket: int = 64) -> DataFrame:
    """(doc_id, text): the texts of a document's pages in order, two line feeds between them; NULL texts count as empty.

    Pages are put together in buckets of numbers first, then the buckets, so a document of very many
    pages is joined by several tasks, and none sorts all of its pages.  Pages of one number come in order of their texts.
    """
    page = F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))
    parts = pages.groupBy("doc_id", F.floor(F.col("page_no") / bucket).alias("part")).agg(F.sort_array(F.collect_list(page)).alias("p"))
    parts = parts.select("doc_id", F.struct("part", F.array_join("p.text", "\n\n").alias("text")).alias("part"))
    return parts.groupBy("doc_id").agg(F.sort_array(F.collect_list("part")).alias("p")).select("doc_id", F.array_join("p.text", "\n\n").alias("text"))


def metadata_available(metadata: Column) -> Column:
    """Whether any metadata value says something."""
    return F.exists(F.map_values(metadata), lambda v: (F.length(strip(v)) > 0) & (v != "0"))
