"""Rules about document metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.functions.dates import parse_date
from inkproof.operators.markers.base import emit, join, marker


def meta(metadata: Column, key: str) -> Column:
    """Metadata value, the empty string when absent."""
    return F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(""))


def close_timestamps(created: Column, modified: Column) -> Column:
    """Markers for two timestamps less than one, or less than five, seconds apart."""
    gap = F.abs(F.unix_micros(modified) - F.unix_micros(created)) / 1e6

    def found(severity: str, description: str, shown: str, score: float) -> Column:
        return marker(
            "metadata", "suspicious_timestamps", severity, description,
            F.format_string(f"Time difference between creation and modification: {shown} seconds", gap),
            score,
        )

    return F.concat(
        emit(gap < 1, found("medium", "Creation and modification times are suspiciously close", "%.2f", 0.5)),
        emit((gap >= 1) & (gap < 5), found("low", "Creation and modification times are very close", "%.1f", 0.35)),
    )


def suspicious_timestamps(metadata: Column) -> Column:
    created = parse_date(meta(metadata, "creation_date")).cast("timestamp")
    modified = parse_date(meta(metadata, "modification_date")).cast("timestamp")
    return T.let(
        F.struct(created.alias("created"), modified.alias("modified")),
        lambda t: close_timestamps(t["created"], t["modified"]),
    )


def missing_metadata_names(metadata: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(meta(metadata, key) == "", F.lit(name)) for key, name in C.ESSENTIAL_METADATA
    ]))


def missing_metadata(metadata: Column) -> Column:
    return T.let(
        missing_metadata_names(metadata),
        lambda gone: emit(
            F.size(gone) > 0,
            marker(
                "metadata", "missing_metadata", "low",
                F.format_string("Document is missing %d essential metadata fields", F.size(gone)),
                F.concat(F.lit("Missing fields: "), join(gone)),
                0.2 + 0.05 * F.size(gone),
            ),
        ),
    )


def inconsistent_creator(metadata: Column) -> Column:
    """Creator and producer share no word and both have more than five characters."""
    creator, producer = meta(metadata, "creator"), meta(metadata, "producer")
    words = F.struct(
        T.tokens(F.lower(creator)).alias("a"), T.tokens(F.lower(producer)).alias("b")
    )
    return T.let(
        words,
        lambda w: emit(
            (F.size(w["a"]) > 0) & (F.size(w["b"]) > 0) & ~F.arrays_overlap(w["a"], w["b"])
            & (F.length(creator) > 5) & (F.length(producer) > 5),
            marker(
                "metadata", "inconsistent_creator", "medium",
                "Creator and producer metadata suggest different applications",
                F.format_string("Creator: '%s', Producer: '%s'", creator, producer),
                0.55,
            ),
        ),
    )


def metadata_rules(metadata: Column) -> Column:
    return F.concat(
        suspicious_timestamps(metadata), missing_metadata(metadata), inconsistent_creator(metadata)
    )
