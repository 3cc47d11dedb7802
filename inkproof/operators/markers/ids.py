"""Rules about identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions import constants as C
from inkproof.functions import text as T
from inkproof.operators.markers.base import emit, emit_many, join, marker


def rule_ids(text: Column) -> Column:
    """Identifier strings, pattern by pattern; the patterns overlap on purpose."""
    return T.find_each(text, C.RULE_ID_PATTERNS)


def clean_id(value: Column) -> Column:
    return F.regexp_replace(value, "[^a-zA-Z0-9]", "")


def repeated_id_counts(found: Column) -> Column:
    """No identifier begins or ends with white space."""
    return T.repeats(F.transform(found, lambda v: F.upper(v)))


def repeated_ids(found: Column) -> Column:
    def rule(repeated: Column) -> Column:
        top = F.transform(
            T.most_frequent(repeated, 5),
            lambda c: F.format_string("%s (appears %dx)", c["value"], c["n"]),
        )
        return emit(
            F.size(repeated) > 0,
            marker(
                "id_reference", "repeated_ids", "medium",
                F.format_string("Found %d ID/reference numbers appearing multiple times", F.size(repeated)),
                F.concat(F.lit("Repeated IDs: "), join(top, "; ")),
                F.least(0.5 + 0.1 * F.size(repeated), F.lit(0.8)),
            ),
        )

    return T.let(repeated_id_counts(found), rule)


def malformed_id_list(found: Column) -> Column:
    """``array<struct<id, reason>>``: one repeated character, or digits that count up."""

    def reason(clean: Column) -> Column:
        return F.when(
            clean.rlike(r"^(.)\1{3,}$"),
            F.concat(F.lit("All characters are '"), F.left(clean, F.lit(1)), F.lit("'")),
        ).when(
            (F.length(clean) > 4) & (F.instr(F.lit("0123456789"), clean) > 0),
            F.lit("Sequential digits"),
        )

    return F.filter(
        F.transform(
            F.transform(found, lambda v: F.struct(v.alias("id"), clean_id(v).alias("clean"))),
            lambda m: F.struct(m["id"].alias("id"), reason(m["clean"]).alias("reason")),
        ),
        lambda m: m["reason"].isNotNull(),
    )


def malformed_patterns(found: Column) -> Column:
    return T.let(
        malformed_id_list(found),
        lambda bad: emit(
            F.size(bad) > 0,
            marker(
                "id_reference", "malformed_patterns", "medium",
                "ID numbers with suspicious patterns",
                F.concat(F.lit("Malformed IDs: "), join(F.transform(
                    F.slice(bad, 1, 5), lambda m: F.format_string("%s (%s)", m["id"], m["reason"])), "; ")),
                0.7,
            ),
        ),
    )


def inconsistent_prefixes(found: Column) -> Column:
    """``array<struct<first, prefix, ids>>``: prefixes whose identifiers differ in length.

    Identifiers are sorted by prefix once and cut at prefix changes.
    """

    def groups(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i)["prefix"] != F.get(s, i - 1)["prefix"]),
        )
        cut = T.let(starts, lambda b: F.transform(
            b,
            lambda start, j: F.slice(s, start + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - start),
        ))
        return F.sort_array(F.transform(
            F.filter(cut, lambda g: F.size(F.array_distinct(F.transform(g, lambda m: m["width"]))) > 1),
            lambda g: F.struct(
                F.get(g, F.lit(0))["first"].alias("first"),
                F.get(g, F.lit(0))["prefix"].alias("prefix"),
                F.transform(g, lambda m: m["id"]).alias("ids"),
            ),
        ))

    lettered = F.filter(
        F.transform(found, lambda v, i: F.struct(v.alias("id"), i.alias("first"))),
        lambda m: m["id"].rlike("^[A-Za-z-]"),
    )

    def by_prefix(kept: Column) -> Column:
        return F.sort_array(F.transform(kept, lambda m: F.struct(
            F.rtrim(F.upper(F.regexp_extract(m["id"], "^[A-Za-z-]+", 0)), F.lit("-")).alias("prefix"),
            m["first"].alias("first"),
            m["id"].alias("id"),
            F.length(clean_id(m["id"])).alias("width"),
        )))

    return T.let(lettered, lambda kept: F.when(F.size(kept) > 1, T.let(by_prefix(kept), groups)))


def inconsistent_ids(found: Column) -> Column:
    marked = F.transform(
        inconsistent_prefixes(found),
        lambda g: marker(
            "id_reference", "inconsistent_ids", "medium",
            F.format_string("ID numbers with prefix '%s' have inconsistent formats", g["prefix"]),
            F.concat(
                F.format_string("IDs with prefix '%s' have inconsistent formats: ", g["prefix"]),
                join(F.slice(g["ids"], 1, 5)),
            ),
            0.65,
        ),
    )
    return emit_many(marked.isNotNull(), marked)


def ids_rules(text: Column) -> Column:
    return T.let(
        rule_ids(text),
        lambda found: emit_many(
            F.size(found) > 0,
            F.concat(repeated_ids(found), malformed_patterns(found), inconsistent_ids(found)),
        ),
    )
