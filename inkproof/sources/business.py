"""Business documents rendered from the star schema.

The prose corpus holds no totals, dates or identifiers, so the rules about them run on
one rendered document per order (invoice, receipt, certificate or agreement).  Each kind
of damage is injected by its own modulus of the order key, so every rule has both hits
and misses.  The text template is plain SQL that both Spark and an ANSI engine accept;
only the date formatting differs by dialect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.sources.tables import table

AS_OF = "2001-08-08"


@dataclass(frozen=True)
class Dialect:
    mdy: str
    iso: str
    long: str

    def fmt(self, style: str, expr: str) -> str:
        return getattr(self, style).format(expr)


SPARK = Dialect(
    "date_format({}, 'MM/dd/yyyy')", "date_format({}, 'yyyy-MM-dd')", "date_format({}, 'MMMM dd, yyyy')"
)
ANSI = Dialect("strftime({}, '%m/%d/%Y')", "strftime({}, '%Y-%m-%d')", "strftime({}, '%B %d, %Y')")

KIND = (
    "CASE k % 5 WHEN 2 THEN 'receipt' WHEN 3 THEN 'certificate' WHEN 4 THEN 'agreement' "
    "ELSE 'invoice' END"
)


def body_sql(d: Dialect) -> str:
    """SQL for the text body over columns k, d, c_name, n_lines, net, tax."""
    expiry = "(CASE WHEN k % 13 = 0 THEN d - INTERVAL 30 DAY ELSE d + INTERVAL 30 DAY END)"
    # every fourth document dates itself in ISO form, the others month first
    dated = f"(CASE WHEN k % 4 = 0 THEN {d.fmt('iso', '{}')} ELSE {d.fmt('mdy', '{}')} END)"
    number = "(CASE WHEN k % 23 = 0 THEN '77777777' WHEN k % 59 = 0 THEN '12345678' ELSE lpad(CAST(k AS STRING), 8, '0') END)"
    lines = [
        "CASE k % 5 WHEN 2 THEN 'RECEIPT' WHEN 3 THEN 'CERTIFICATE OF SUPPLY' "
        "WHEN 4 THEN 'SUPPLY AGREEMENT' ELSE 'INVOICE' END",
        "CASE WHEN k % 35 = 0 THEN 'Page 1' END",
        f"concat(CASE k % 5 WHEN 2 THEN 'Receipt for transaction no REC-' WHEN 3 THEN 'Certificate No CRT-' "
        f"WHEN 4 THEN 'Contract between the parties AGR-' ELSE 'Invoice Number: INV-' END, {number})",
        f"concat('Issue Date: ', {dated.replace('{}', 'd')})",
        f"concat('Valid Until: ', {dated.replace('{}', expiry)})",
        "CASE WHEN k % 47 <> 0 THEN concat('Bill To: ', c_name) END",
        "CASE WHEN k % 47 <> 0 THEN concat('Item: goods as ordered, ', CAST(n_lines AS STRING), ' lines') END",
        "concat('Subtotal: $', CAST(net AS STRING))",
        "concat('Tax: $', CAST(tax AS STRING))",
        "concat('Total: $', CAST((CASE WHEN k % 7 = 0 THEN CAST(net + tax + net * CAST(0.10 AS DECIMAL(4,2)) "
        "AS DECIMAL(18,2)) ELSE CAST(net + tax AS DECIMAL(18,2)) END) AS STRING))",
        "CASE WHEN k % 47 <> 0 THEN 'Payment Terms: 30 days' END",
        "CASE WHEN k % 3 = 0 THEN 'The client named above is the customer of record.' END",
        "CASE WHEN k % 11 = 0 THEN '---' END",
        "CASE WHEN k % 11 = 0 THEN concat('Delivered: 02/30/', CAST(year(d) AS STRING)) END",
        f"CASE WHEN k % 17 = 0 THEN concat('Renewal: ', {d.fmt('long', '(d + INTERVAL 40 YEAR)')}) END",
        f"CASE WHEN k % 27 = 0 THEN concat('Printed: ', {d.fmt('iso', 'd')}) END",
        "CASE WHEN k % 19 = 0 THEN concat('Reference: REF ', lpad(CAST(k + 90000 AS STRING), 6, '0'), "
        "' and REF ', lpad(CAST(k + 90000 AS STRING), 6, '0')) END",
        "CASE WHEN k % 61 = 0 THEN concat('See PO-', CAST(k + 1000 AS STRING), ' and PO-', CAST(k + 5000000 AS STRING)) END",
        "CASE WHEN k % 31 = 0 THEN 'Signed by [Full Name] on [Date] ____' END",
        "CASE WHEN k % 37 = 0 THEN concat('Pay now', repeat('!', 12)) END",
        "CASE WHEN k % 33 = 0 THEN concat('Notes ', repeat('...', 6)) END",
        "CASE WHEN k % 41 = 0 THEN 'Cost allocation: 40% labour, 35% parts, 20% freight' END",
        "CASE WHEN k % 21 = 0 THEN 'This is a certified true copy of the original document.' END",
        "CASE WHEN k % 63 = 0 THEN 'Specimen copy, draft copy.' END",
        "CASE WHEN k % 25 = 0 THEN repeat('The goods remain the property of the seller. ', "
        "CASE WHEN k % 50 = 0 THEN 4 ELSE 2 END) END",
        "CASE WHEN k % 43 = 0 THEN 'Continued on page 9' END",
        "CASE WHEN k % 35 = 0 THEN 'Page 2' END",
    ]
    return f"concat_ws(chr(10), {', '.join(lines)})"


def column_sql(d: Dialect) -> dict[str, str]:
    """Every document column as SQL over the per-order base columns."""
    iso = d.fmt("iso", "d")
    later = d.fmt("iso", "(d + INTERVAL 1 DAY)")
    return {
        "doc_id": "k",
        "doc_kind": KIND,
        "filename": f"concat({KIND}, '_', CAST(k AS STRING), "
        "CASE k % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' ELSE '.docx' END)",
        "file_type": "CASE k % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' ELSE 'docx' END",
        "text": "CASE WHEN k % 29 = 0 THEN upper(body) ELSE body END",
        "md_title": "CASE WHEN k % 4 <> 1 THEN concat('Order ', CAST(k AS STRING)) END",
        "md_author": "CASE WHEN k % 6 <> 0 THEN c_name WHEN k % 12 = 0 THEN '' END",
        "md_creator": "CASE WHEN k % 7 <> 3 THEN 'Ledger Suite' END",
        "md_producer": "CASE WHEN k % 9 = 0 THEN 'Pdf Forge Tool' ELSE 'Ledger Export' END",
        "md_creation_date": f"CASE WHEN k % 8 <> 5 THEN {iso} END",
        "md_modification_date": f"CASE WHEN k % 53 = 0 THEN {iso} WHEN k % 10 <> 1 THEN {later} END",
        "md_subject": "CASE WHEN k % 2 = 0 THEN 'Supply' END",
        "page_count": "CAST(1 + k % 5 AS INT)",
        "table_count": "CAST(CASE WHEN k % 90 = 0 THEN 21 WHEN k % 30 = 0 THEN 9 ELSE k % 4 END AS INT)",
        "blank_page_count": "CAST(CASE WHEN k % 15 = 0 THEN 1 + k % 2 ELSE 0 END AS INT)",
        "image_count": "CAST(k % 3 AS INT)",
        "font_size_variance": "CAST(k % 40 AS DOUBLE) / 4",
        "alignment_variance": "CAST(k % 13 AS DOUBLE) / 4",
        "ocr_used": "(k % 8 = 0)",
        "ocr_confidence": "CASE WHEN k % 8 = 0 THEN CAST(40 + k % 60 AS DOUBLE) / 100 "
        "WHEN k % 16 = 1 THEN CAST(0 AS DOUBLE) END",
        "ocr_pages": "CAST(CASE WHEN k % 8 = 0 THEN 1 + k % 3 ELSE 0 END AS INT)",
        "image_only_pages": "CAST(CASE WHEN k % 24 = 0 THEN 2 ELSE 0 END AS INT)",
        "suspicious_region_count": "CAST(CASE WHEN k % 12 = 0 THEN k % 5 ELSE 0 END AS INT)",
        "width": "CAST(CASE WHEN k % 18 = 0 THEN 200 + 50 * (k % 20) END AS INT)",
        "height": "CAST(CASE WHEN k % 18 = 0 THEN 1000 - 40 * (k % 20) END AS INT)",
        "uploaded_at": "d",
        "label": "CASE WHEN k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 "
        "OR k % 23 = 0 OR k % 31 = 0 OR k % 41 = 0 THEN 1 ELSE 0 END",
    }


STATS_FIELDS = [
    "page_count", "table_count", "blank_page_count", "image_count", "font_size_variance",
    "alignment_variance", "ocr_used", "ocr_confidence", "ocr_pages", "image_only_pages",
    "suspicious_region_count", "width", "height",
]
METADATA_KEYS = [
    "title", "author", "creator", "producer", "creation_date", "modification_date", "subject",
]
_NET = "CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))"
BASE_SQL = f"""
SELECT o_orderkey AS k, o_orderdate AS d, c_name, n_lines, net, tax
FROM (SELECT l_orderkey, count(*) AS n_lines,
             CAST(sum({_NET}) AS DECIMAL(18,2)) AS net,
             CAST(sum({_NET} * CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS tax
      FROM lineitem GROUP BY l_orderkey) l
JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey
"""


def render_ansi() -> str:
    """The rendered corpus as ANSI SQL, one flat row per document."""
    cols = ",\n       ".join(f"{sql} AS {name}" for name, sql in column_sql(ANSI).items())
    return f"SELECT {cols}\nFROM (SELECT *, {body_sql(ANSI)} AS body FROM ({BASE_SQL}) base) rendered"


def business_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: text, metadata map, stats struct, label."""
    net = (
        F.col("l_extendedprice").cast("decimal(12,2)")
        * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    )
    totals = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(net).cast("decimal(18,2)").alias("net"),
            F.sum(net * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,2)").alias("tax"),
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    base = (
        totals.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"),
            "c_name", "n_lines", "net", "tax",
        )
    )
    flat = base.selectExpr("*", f"{body_sql(SPARK)} AS body").selectExpr(*[f"{sql} AS `{name}`" for name, sql in column_sql(SPARK).items()])
    metadata = F.map_filter(
        F.create_map(*[x for key in METADATA_KEYS for x in (F.lit(key), F.col(f"md_{key}"))]),
        lambda _, value: value.isNotNull(),
    )
    return flat.select(
        "doc_id", "doc_kind", "filename", "file_type", "text",
        metadata.alias("metadata"),
        F.struct(*STATS_FIELDS).alias("stats"),
        "uploaded_at", "label",
    )
