"""Document-type classification from weighted patterns and the file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators import doctype_batch
from inkproof.session import per_session


#: The words that the patterns of all categories lead with.
HEADS = sorted({h for rules in C.DOCTYPE_RULES.values() for _, regex in rules for h in T.leading_words(regex)})


def category_score(low: Column, begun: Column, category: str) -> Column:
    """Weighted hits in lower-cased text; repeats add a quarter of the weight each, three repeats at most."""
    total, boost = F.lit(0.0), F.array(*[F.lit(b) for b in (0.0, 1.0, 1.25, 1.5, 1.75)])
    for weight, regex in C.DOCTYPE_RULES[category]:
        total = total + T.where_begun(begun, HEADS, regex, weight * F.get(boost, F.least(T.count_matches(low, regex), F.lit(4))), 0.0)
    return F.round(total, 2)


def filename_hint(filename: Column) -> Column:
    low = F.lower(filename)
    hint = F.lit(None).cast("string")
    for category, words in reversed(C.FILENAME_HINTS):
        hint = F.when(T.contains_any(low, words), F.lit(category)).otherwise(hint)
    return hint


def score_array(text: Column, filename: Column | None) -> Column:
    """``array<struct<category, score>>`` with the file-name bonus, rule order, hits only."""
    hint = filename_hint(filename) if filename is not None else F.lit(None).cast("string")

    def scored(low: Column, begun: Column, category: str) -> Column:
        bonus = F.when(hint == category, F.lit(C.FILENAME_HINT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(category).alias("category"),
            (category_score(low, begun, category) + bonus).alias("score"),
        )

    return T.by_text(text, lambda t: T.let(
        F.lower(t),
        lambda low: T.let(T.as_line(T.begun_words(low, HEADS)), lambda begun: F.filter(
            F.array(*[scored(low, begun, c) for c in C.DOCTYPE_RULES]), lambda s: s["score"] > 0)),
    ))


def ranked_scores(scores: Column, hint: Column) -> Column:
    """Best first; on a tie the earlier rule wins and a category known only by its hint loses."""
    tagged = F.transform(
        scores,
        lambda s, i: F.struct(
            (-s["score"]).alias("k"),
            ((hint == s["category"]) & (s["score"] == C.FILENAME_HINT_BONUS)).alias("hint_only"),
            i.alias("order"),
            s["category"].alias("category"),
            s["score"].alias("score"),
        ),
    )
    return F.array_sort(tagged)


@per_session
def batched_type(filename_col: str | None) -> Column:
    """:func:`type_column` of ASCII texts and file names, found for a batch of texts at once; NULL for all others."""
    text = F.col("text")
    filename = F.col(filename_col) if filename_col else F.lit(None).cast("string")
    found = F.arrow_udf(doctype_batch.types, "struct<type:string,score:double,margin:double>")
    return found(F.when(T.is_ascii(text) & (filename.isNull() | T.is_ascii(filename)), text), filename)


@per_session
def type_column(filename_col: str | None) -> Column:
    """struct(type, score, margin) of the winning category."""
    text = F.col("text")
    filename = F.col(filename_col) if filename_col else None
    hint = F.coalesce(filename_hint(filename), F.lit("")) if filename_col else F.lit("")

    def verdict(r: Column) -> Column:
        best = F.coalesce(F.get(r, F.lit(0))["score"], F.lit(0.0))
        usable = (best >= C.DOCTYPE_MIN_SCORE) & ~T.is_blank(text)
        return F.struct(
            F.when(usable, F.get(r, F.lit(0))["category"]).otherwise(F.lit("unknown")).alias("type"),
            best.alias("score"),
            (best - F.coalesce(F.get(r, F.lit(1))["score"], F.lit(0.0))).alias("margin"),
        )

    return T.let(ranked_scores(score_array(text, filename), hint), verdict)


def classify(df: DataFrame, filename_col: str | None = "filename") -> DataFrame:
    """Add ``document_type``, ``type_score`` and ``type_margin``."""
    return (
        df.withColumn("_type", F.coalesce(batched_type(filename_col), type_column(filename_col)))
        .withColumns({
            "document_type": F.col("_type.type"),
            "type_score": F.col("_type.score"),
            "type_margin": F.col("_type.margin"),
        })
        .drop("_type")
    )
