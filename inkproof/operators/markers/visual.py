"""Rules about image and scan quality statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators.markers.base import emit, marker


def compression_artifacts(regions: Column) -> Column:
    n = regions.cast("int")
    return emit(
        n > 0,
        marker(
            "visual", "compression_artifacts", F.when(n < 3, "medium").otherwise("high"),
            F.format_string("Found %d regions with suspicious compression patterns", n),
            F.format_string("%d suspicious regions detected possibly indicating image manipulation", n),
            F.least(0.4 + n * 0.1, F.lit(0.85)),
        ),
    )


def low_resolution(width: Column, height: Column) -> Column:
    return emit(
        (width < C.MIN_RESOLUTION) | (height < C.MIN_RESOLUTION),
        marker(
            "visual", "resolution_issues", "low", "Document has unusually low resolution",
            F.format_string("Resolution: %dx%d (below 300px threshold)", width, height), 0.4,
        ),
    )


def low_ocr_confidence(confidence: Column) -> Column:
    return emit(
        confidence < C.MIN_OCR_CONFIDENCE,
        marker(
            "visual", "resolution_issues", "medium", "Low OCR confidence suggests quality issues",
            F.concat(F.lit("OCR confidence: "), T.percent_text(confidence), F.lit(" (below 60% threshold)")),
            F.least(0.5 + (C.MIN_OCR_CONFIDENCE - confidence), F.lit(0.8)),
        ),
    )


def visual_rules(regions: Column, width: Column, height: Column, confidence: Column) -> Column:
    return F.concat(
        compression_artifacts(regions), low_resolution(width, height), low_ocr_confidence(confidence)
    )
