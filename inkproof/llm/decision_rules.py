"""Quality rules: a decision list learnt by sequential covering, with DataFrame functions only.

Rules that reject are grown one condition (feature at least / below a threshold) at a time by
information gain on one part of the labelled rows, pruned from the end on the other part, and put
out in order as one conditional expression. All that is ever gathered is a count for each feature
and bin; thresholds are quantiles of the labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import BLANK_CHARACTERS, let, stored, words_of

#: Least words and largest percentage of repeated words of the base rules.
LEAST_WORDS, REPEATED_PERCENT = 50, 50
MAX_RULES, MAX_CONDITIONS = 12, 3
#: A rule must be right that often on the pruning part, on that many rows at least.
LEAST_PRECISION, LEAST_ROWS = 0.9, 4
QUANTILES = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995]
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included.

    The windows' hashes are sorted with their places; equal neighbours give the places, and a place
    covers three words or those up to the next one.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.struct(a["i"].alias("a"), b["i"].alias("b"))))
        pairs = F.filter(same, lambda x: x.isNotNull())
        return let(pairs, lambda p: F.sort_array(F.array_union(F.transform(p, lambda x: x["a"]), F.transform(p, lambda x: x["b"]))))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    return F.when(F.size(words) > 3, let(let(F.sort_array(windows), places), covered)).otherwise(0).cast("long")


def repeated_lines(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK_CHARACTERS))) > 0)
    return let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures and the features of every row of docs (doc_id, text); a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("words")
    rows = docs.select("doc_id", text.alias("text"), words_of(text).alias("words"))
    rows = rows.select(
        "doc_id", F.size(words).cast("long").alias("n_words"), without(F.col("text"), BLANK_CHARACTERS).cast("long").alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"),
        F.size(F.array_distinct(words)).alias("distinct"),
        (F.length("text") - without(F.col("text"), CAPITALS)).alias("capitals"), (F.length("text") - without(F.col("text"), "!")).alias("calls"),
        (F.length("text") - without(F.col("text"), "0123456789")).alias("digits"), (F.length("text") - without(F.col("text"), ".,;:?")).alias("stops"),
        (F.length("text") - without(F.col("text"), "\n") + 1).alias("lines"))
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        "doc_id", *base, *[f.alias(f"f_{n}") for n, f in {
            "words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
            "repeated_lines": per("n_dup_lines", "lines"), "repeated_words": per("n_repeat_words", "n_words"), "distinct_words": per("distinct", "n_words"),
            "capitals": per("capitals", "word_chars"), "calls_per_word": per("calls", "n_words"), "digits": per("digits", "word_chars"),
            "stops_per_word": per("stops", "n_words"), "words_per_line": per("n_words", "lines"),
        }.items()])


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bin: int
    threshold: float

    def on_bins(self) -> Column:
        return F.col(self.feature) >= self.bin if self.at_least else F.col(self.feature) < self.bin

    def on_values(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) < self.threshold

    def __str__(self) -> str:
        return f"{self.feature[2:]} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def all_of(conditions: Rule, binned: bool) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & (c.on_bins() if binned else c.on_values())
    return out


def learn(rows: DataFrame, features: list[str]) -> list[Rule]:
    """rows: the features and bad (0/1), grow (the part for growing) of every labelled row."""
    cuts = rows.agg(*[F.percentile_approx(f, QUANTILES, 10_000).alias(f) for f in features]).first()
    steps = {f: sorted(set(cuts[f] or [])) for f in features}
    binned = [sum((F.when(F.col(f) >= t, 1).otherwise(0) for t in steps[f]), F.lit(0)).alias(f) for f in features]
    weigh = lambda c: F.sum(c.cast("long"))
    bad, grow = F.col("bad") == 1, F.col("grow")
    table = stored(
        rows.select("bad", "grow", *binned).groupBy(*features)
        .agg(weigh(grow & bad).alias("gp"), weigh(grow & ~bad).alias("gn"), weigh(~grow & bad).alias("pp"), weigh(~grow & ~bad).alias("pn")), "bins")
    rules: list[Rule] = []
    left = table
    while len(rules) < MAX_RULES:
        rule = _prune(left, _grow(left, features, steps))
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~all_of(rule, True))
    return rules


def _grow(left: DataFrame, features: list[str], steps: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features])).alias("x")
        counts = (
            left.filter(all_of(rule, True)).select("gp", "gn", pairs).groupBy("x.f", "x.b")
            .agg(F.sum("gp").alias("p"), F.sum("gn").alias("n")).collect()  # a row for each feature and bin
        )
        total_p = sum(r.p for r in counts if r.f == features[0])
        total_n = sum(r.n for r in counts if r.f == features[0])
        if not total_p or not total_n:
            break
        best = (0.0, None)
        for f in features:
            for b, threshold in enumerate(steps[f], 1):
                above_p = sum(r.p for r in counts if r.f == f and r.b >= b)
                above_n = sum(r.n for r in counts if r.f == f and r.b >= b)
                for side, p, n in ((True, above_p, above_n), (False, total_p - above_p, total_n - above_n)):
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(total_p / (total_p + total_n)))
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(f, side, b, threshold))
        if best[1] is None:
            break
        rule = (*rule, best[1])
    return rule


def _prune(left: DataFrame, rule: Rule) -> Rule:
    """The beginning of the rule that is right most often on the pruning part, or none."""
    if not rule:
        return ()
    ends = range(1, len(rule) + 1)
    sums = left.agg(*[F.sum(F.when(all_of(rule[:k], True), F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in ends for c in ("pp", "pn")]).first()
    scored = [((sums[f"pp{k}"] - sums[f"pn{k}"]) / max(1, sums[f"pp{k}"] + sums[f"pn{k}"]), k) for k in ends]
    _, k = max(scored, key=lambda s: (s[0], -s[1]))
    p, n = sums[f"pp{k}"] or 0, sums[f"pn{k}"] or 0
    return rule[:k] if p + n >= LEAST_ROWS and p >= LEAST_PRECISION * (p + n) else ()


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, rule (the first that rejects, as text) and kept for every row.

    Learns from labels (doc_id, quality): 0 is bad. Null texts are empty and fail the base rules. Without
    labelled rows of both kinds the list is empty and the base rules alone decide. Labels repeated for
    an id count once (the worst).
    """
    rows = stored(measured(docs), "features")
    features = [c for c in rows.columns if c.startswith("f_")]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    train = rows.filter(~failed).join(known, "doc_id").select(
        *features, (F.col("quality") == 0).cast("int").alias("bad"),
        (F.crc32(F.concat(F.lit("grow/"), F.col("doc_id").cast("string")).cast("binary")) % 3 > 0).alias("grow"))
    rules = learn(stored(train, "train"), features)
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(all_of(rule, False), " and ".join(map(str, rule))).otherwise(verdict)
    out = rows.withColumn("base_failed", failed).withColumn("rule", verdict)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
