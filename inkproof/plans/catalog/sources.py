"""Source queries over file tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkproof.plans import oracle as O
from inkproof.plans.registry import query
from inkproof.sources import files as S
from inkproof.sources.tables import table


@query("src_corpus_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def corpus_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


_ENCODED = """SELECT doc_id, doc_id % 4 AS k, text, repeat(chr(44173), CAST(1 + doc_id % 40 AS INTEGER)) AS hangul FROM documents"""


@query("src_text_file_ingest", f"""SELECT doc_id, CASE k WHEN 1 THEN NULL WHEN 3 THEN md5(hangul) ELSE md5(text) END AS text_hash,
CASE k WHEN 0 THEN 'utf-8-sig (BOM)' WHEN 2 THEN 'utf-8' WHEN 3 THEN 'utf-16' END AS encoding, k <> 2 AS has_bom,
CASE WHEN k = 3 THEN 1 WHEN k <> 1 THEN CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END END AS line_count,
CASE WHEN k = 1 THEN {O.q(S.BINARY_FILE)} END AS error FROM ({_ENCODED}) t""")
def text_file_ingest(spark, sf_dir):
    """UTF-8 with and without a mark; UTF-16 of Latin letters, which has NUL bytes; and UTF-16 of Hangul, which has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind, utf8 = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    hangul = F.repeat(F.lit(chr(44173)), (1 + F.col("doc_id") % 40).cast("int"))
    content = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(kind == 3, F.concat(F.unhex(F.lit("FFFE")), F.encode(hangul, "UTF-16LE")))
        .otherwise(utf8))
    read = S.decode_files(docs.select("doc_id", content.alias("content")))
    return read.select("doc_id", F.md5("text").alias("text_hash"), "encoding", "has_bom", "line_count", "error")


@query("src_unknown_type_ingest", """SELECT doc_id, doc_id % 2 = 0 AS is_text, CASE WHEN doc_id % 2 = 1 THEN 'Unsupported file type: dat' END AS error FROM documents""")
def unknown_type_ingest(spark, sf_dir):
    """Names with an unknown extension; every second content has a NUL byte at its end."""
    tail = F.when(F.col("doc_id") % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id"), F.lit(".DAT")).alias("name"), F.concat(F.encode("text", "UTF-8"), tail).alias("content"))
    return S.ingest_unknown(files).select("doc_id", F.col("text").isNotNull().alias("is_text"), "error")


NAME = "concat(CASE p_partkey % 4 WHEN 0 THEN 'C:\\in\\' WHEN 1 THEN '../up/' ELSE '' END, p_name, ' (', CAST(p_partkey AS STRING), ')', CASE p_partkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' WHEN 2 THEN '.docx' WHEN 3 THEN '' ELSE '.png' END)"
SIZE = "(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey * 20000 END)"


def uploads(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(NAME.replace("\\", "\\\\")).alias("name"), F.expr(SIZE).alias("size"))


@query("src_upload_filter", f"""SELECT coalesce(CASE WHEN p_partkey % 5 = 3 AND p_partkey % 4 <> 1 THEN 'no extension' WHEN p_partkey % 5 IN (1, 3) THEN 'extension not allowed'
WHEN {SIZE} = 0 THEN 'File is empty' WHEN {SIZE} > 26214400 THEN 'too large' END, 'accepted') AS status, count(*) AS n FROM part GROUP BY 1""")
def upload_filter(spark, sf_dir):
    status = F.coalesce(S.upload_status(F.col("name"), F.col("size")), F.lit("accepted"))
    return uploads(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("src_filename_sanitize", """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'document_' || substr(md5('../__' || p_partkey % 50 || '/--.TXT'), 1, 12) || '.txt' ELSE
trim(regexp_replace(regexp_replace(concat(p_name, ' (', CAST(p_partkey AS VARCHAR), ')'), '[^\\w.-]', '_', 'g'), '_{2,}', '_', 'g'), '_-')
|| CASE p_partkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.exe' WHEN 2 THEN '.docx' WHEN 3 THEN '' ELSE '.png' END END AS safe FROM part""")
def filename_sanitize(spark, sf_dir):
    """Every seventh name has no usable stem."""
    empty = F.concat(F.lit("../__"), F.col("p_partkey") % 50, F.lit("/--.TXT"))
    name = F.when(F.col("p_partkey") % 7 == 0, empty).otherwise(F.col("name"))
    return uploads(spark, sf_dir).select("p_partkey", S.sanitize_filename(name).alias("safe"))


@query("src_mime_sniff", """SELECT mime, ext, (ext = 'txt') OR (ext = 'pdf' AND mime = 'application/pdf') OR (ext = 'png' AND mime = 'image/png') OR (ext = 'docx' AND mime LIKE 'application/vnd.openxml%') AS matches, count(*) AS n
FROM (SELECT e AS ext, CASE p_partkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE CASE e WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png'
WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END END AS mime
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'docx' ELSE 'txt' END AS e FROM part) a) b GROUP BY ALL""")
def mime_sniff(spark, sf_dir):
    """By content, else by name; and whether the type suits the name."""
    key = F.col("p_partkey")
    magic = F.when(key % 3 == 0, F.lit("25504446")).when(key % 3 == 1, F.lit("89504E470D0A1A0A")).otherwise(F.lit("00"))
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "png", "docx", "txt"))), (key % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select(ext.alias("ext"), F.concat(F.lit("f."), ext).alias("name"), F.concat(F.unhex(magic), F.encode("p_name", "UTF-8")).alias("content"))
    mime = S.sniff_mime(F.col("content"), F.col("name"))
    rows = files.select("ext", "name", mime.alias("mime")).withColumn("matches", S.mime_matches(F.col("name"), F.col("mime")))
    return rows.groupBy("mime", "ext", "matches").agg(F.count(F.lit(1)).alias("n"))
