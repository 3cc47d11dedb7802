"""Ingest of raw files: decoding, validation, MIME sniffing, dataset columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T

BINARY_FILE = "File appears to be binary, not plain text"
UNKNOWN_TYPE = "application/octet-stream"


def is_utf16(content: Column, big_endian: Column) -> Column:
    """Whole 16-bit units, and every high surrogate directly before a low one."""
    digits = F.hex(content)
    first, second = (F.regexp_extract_all(digits, F.lit(p), F.lit(1)) for p in ("(..)..", "..(..)"))
    kind = F.transform(
        F.when(big_endian, first).otherwise(second),
        lambda b: F.when(b.between("D8", "DB"), "H").when(b.between("DC", "DF"), "L").otherwise("."))
    lone = F.regexp_replace(F.array_join(kind, ""), "HL", "").rlike("[HL]")
    return (F.octet_length(content) % 2 == 0) & ~lone


def decode_files(files: DataFrame, head_bytes: int | None = None) -> DataFrame:
    """Add text, encoding, has_bom, line_count and error to rows with binary ``content``.

    UTF-8, then UTF-16, then Latin-1, as the first that decodes.  A NUL byte (in the first
    ``head_bytes``, by default anywhere) or a blank text with control characters is an error;
    then there is no text.  A null content has neither text nor error.
    """
    content = F.col("content")
    head = F.hex(F.substring(content, 1, 3))
    bom8, little, big = head.startswith("EFBBBF"), head.startswith("FFFE"), head.startswith("FEFF")
    utf8 = F.is_valid_utf8(content.cast("string"))
    rest = F.when(little | big, F.substring(content, 3, 2147483647)).otherwise(content)
    utf16 = is_utf16(rest, big)
    text = (
        F.when(utf8 & bom8, F.decode(F.substring(content, 4, 2147483647), "UTF-8")).when(utf8, F.decode(content, "UTF-8"))
        .when(utf16 & big, F.decode(rest, "UTF-16BE")).when(utf16, F.decode(rest, "UTF-16LE"))
        .when(content.isNotNull(), F.decode(content, "ISO-8859-1")))
    encoding = F.when(utf8 & bom8, "utf-8-sig (BOM)").when(utf8, "utf-8").when(utf16, "utf-16").when(content.isNotNull(), "latin-1")
    looked = content if head_bytes is None else F.substring(content, 1, head_bytes)
    read = files.withColumns({"_text": text, "_encoding": encoding})
    blank = T.is_blank(F.col("_text"))
    bad = F.contains(looked, F.unhex(F.lit("00"))) | (blank & F.col("_text").rlike(C.CONTROL_CHARACTERS_PATTERN))
    fine = F.coalesce(~bad, F.lit(True))
    lines = F.when(blank, 0).otherwise(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)
    return read.withColumns({
        "text": F.when(fine, F.col("_text")), "encoding": F.when(fine, F.col("_encoding")),
        "has_bom": bom8 | little | big, "line_count": F.when(fine, lines),
        "error": F.when(~fine, BINARY_FILE),
    }).drop("_text", "_encoding")


def ingest_unknown(files: DataFrame) -> DataFrame:
    """Files of no known type: read as text where that works, else an error that names the type."""
    kind = F.coalesce(extension(F.col("name")), F.lit(""))
    read = decode_files(files)
    return read.withColumn("error", F.when(F.col("error").isNotNull(), F.concat(F.lit("Unsupported file type: "), kind)))


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(T.strip(F.substring_index(name, ".", -1))))


def upload_status(name: Column, size: Column) -> Column:
    """NULL when a file is accepted, else the reason it is not."""
    ext = extension(name)
    return (
        F.when(ext.isNull() | (ext == ""), "no extension")
        .when(~ext.isin(C.ALLOWED_EXTENSIONS), "extension not allowed")
        .when(size == 0, "File is empty")
        .when(size > C.MAX_UPLOAD_BYTES, "too large")
    )


def expected_mimes(name: Column) -> Column:
    """The types that a file of this name may have; none for an unknown extension."""
    types = F.create_map(*[x for k, v in C.EXTENSION_MIME.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(types, extension(name)), F.array().cast("array<string>"))


def sniff_mime(content: Column, name: Column | None = None) -> Column:
    """By the first bytes, else by the name, else the type of any bytes."""
    head = F.hex(F.substring(content, 1, 32))
    mime = F.coalesce(F.get(expected_mimes(name), F.lit(0)), F.lit(UNKNOWN_TYPE)) if name is not None else F.lit(UNKNOWN_TYPE)
    for magic, known in reversed(C.MAGIC_BYTES):
        mime = F.when(head.startswith(magic), F.lit(known)).otherwise(mime)
    return mime


def mime_matches(name: Column, mime: Column) -> Column:
    """Does the type suit the name?  Any type suits an unknown extension."""
    expected = expected_mimes(name)
    return (F.size(expected) == 0) | F.exists(expected, lambda e: F.lower(mime).startswith(e))


def sanitize_filename(name: Column, max_length: int = 200) -> Column:
    """Last path part, unsafe characters to ``_``, extension lowered, length bounded.

    A name without a usable stem gets one from the digest of the whole name, so that reruns agree.
    """
    instead = F.concat(F.lit("document_"), F.left(F.md5(F.coalesce(name, F.lit("")).cast("binary")), F.lit(12)))
    last = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    has_ext = last.contains(".")
    ext = F.when(has_ext, F.concat(F.lit("."), F.lower(F.substring_index(last, ".", -1)))).otherwise(F.lit(""))
    stem = F.when(has_ext, F.regexp_extract(last, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(last)
    safe = F.btrim(F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w\-.]", "_"), "_{2,}", "_"), F.lit("_-"))
    named = F.when(F.length(safe) > 0, safe).otherwise(instead)
    whole = F.concat(F.left(named, F.lit(max_length) - F.length(ext)), ext)
    return F.when(F.coalesce(T.is_blank(name), F.lit(True)), instead).otherwise(whole)


def resolve_column(columns: list[str], aliases: list[str], explicit: str | None = None) -> str:
    """The dataset column that carries one of the accepted names."""
    by_name = {c.strip().lower(): c for c in columns}
    for name in [explicit] if explicit else aliases:
        if name.strip().lower() in by_name:
            return by_name[name.strip().lower()]
    raise ValueError(f"no column named one of {aliases}; available: {columns}")
