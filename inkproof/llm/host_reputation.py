"""Empirical-Bayes host reputation, with DataFrame functions only.

Labelled outcomes of pages are counted by host, registered domain and suffix. Each level's beta prior
has the mean of the level above it; its strength is the method-of-moments estimate from the spread
of the units of that level. A host's posterior then stands for what its pages are like; unknown hosts
fall back to their domain, suffix or to all. A page is blocked only if even the upper bound of its
posterior share of good pages stays under the threshold. Rules on hosts and paths go first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import stored

#: Second-level labels under which names are registered (fixed values, an argument of `levels`).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Bounds of the estimated prior strength, in pages; standard deviations of the bound; least share of good pages.
STRENGTH, DEVIATIONS, LEAST_GOOD = (1.0, 1000.0), 2.0, 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return f"{self.host}/{self.path}"

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith(f".{self.host}")
        return own & path.startswith(f"/{self.path}")


RULES = (
    Rule("allow", "com", ""), Rule("block", "example.com", "en/"), Rule("allow", "www.example.com", "en/"),
    Rule("block", "net", "es/"), Rule("block", "net", "fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or # or the end, A-Z lower-cased; path: from there to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    authority = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def levels(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port; an address of numbers is its own domain."""
    name = F.regexp_replace(host, r":\d*$", "")
    parts = F.split(name, r"\.")
    n = F.size(parts)
    two = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(*second_level)
    take = F.when(two, 2).otherwise(1)
    number = name.rlike(r"^[0-9.]+$|^\[")
    suffix = F.when(number, F.lit("")).otherwise(F.concat_ws(".", F.slice(parts, F.greatest(n - take + 1, F.lit(1)), take)))
    domain = F.when(number, name).otherwise(F.concat_ws(".", F.slice(parts, F.greatest(n - take, F.lit(1)), F.least(take + 1, n))))
    return domain, suffix


def strength(above: str) -> Column:
    """Prior strength over units (good, pages, prior mean in `above`): from the spread of their shares beyond chance."""
    p = F.col(above)
    chance = F.sum(p * (1 - p))
    within = F.sum(p * (1 - p) / F.col("pages"))
    spread = F.sum(F.pow(F.col("good") / F.col("pages") - p, 2))
    between = (spread - within) / F.greatest(chance - within, F.lit(1e-9))
    low, high = STRENGTH
    return F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), F.when(between > 0, 1 / between - 1).otherwise(high))), F.lit(high))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row for each host: host, pages and good (labelled), mean and the upper and lower posterior bound.

    pages: host, domain, suffix. outcomes: host, domain, suffix, good (0/1). Hosts without a labelled
    page take the mean of what is above them; without any labelled page at all the mean is 0.5.
    """
    count = lambda df, *by: df.groupBy(*by).agg(F.sum("good").alias("good"), F.sum("pages").alias("pages"))
    by_host = stored(outcomes.groupBy("host", "domain", "suffix").agg(F.sum("good").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("pages")), "hosts")
    total = by_host.agg((F.coalesce(F.sum("good"), F.lit(0.0)) + 1).alias("g"), (F.coalesce(F.sum("pages"), F.lit(0.0)) + 2).alias("n")).first()
    mean = total.g / total.n

    def shrunk(units: DataFrame, above: str, name: str) -> DataFrame:
        s = units.agg(strength(above).alias("s")).first()["s"]  # one number
        n = F.col("pages") + s
        return units.select(*units.columns, F.lit(s).alias(f"{name}_strength"), ((F.col("good") + s * F.col(above)) / n).alias(f"{name}_mean"), n.alias(f"{name}_size"))

    all_hosts = pages.select("host", "domain", "suffix").distinct().withColumns({"good": F.lit(0.0), "pages": F.lit(0.0)})
    hosts = stored(count(by_host.unionByName(all_hosts), "host", "domain", "suffix"), "all-hosts")
    suffixes = shrunk(count(by_host, "suffix").withColumn("top", F.lit(mean)), "top", "suffix").select("suffix", "suffix_mean", "suffix_size")
    domains = count(by_host, "domain", "suffix").join(suffixes, "suffix").drop("suffix_size")
    domains = shrunk(stored(domains, "domains"), "suffix_mean", "domain").select("domain", "domain_mean", "domain_size")
    joined = (
        hosts.join(suffixes, "suffix", "left").join(domains, "domain", "left")
        .withColumn("above", F.coalesce("domain_mean", "suffix_mean", F.lit(mean)))
    )
    joined = stored(joined, "placed-hosts")
    s = joined.filter("pages > 0").agg(strength("above").alias("s")).first()["s"]
    n = F.col("pages") + s
    share = (F.col("good") + s * F.col("above")) / n
    deviation = F.sqrt(share * (1 - share) / (n + 1))
    return joined.select(
        "host", F.col("pages").cast("long").alias("pages"), F.col("good").cast("long").alias("good"), share.alias("mean"),
        (share - DEVIATIONS * deviation).alias("lower"), (share + DEVIATIONS * deviation).alias("upper"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """page_id, host, path, rule, verdict, mean and upper for every row of pages (page_id, url).

    outcomes: url, good (0/1); rows without either are left out. Null urls and those without :// have
    empty host and path, and share the reputation of the empty host. Of the rules that fit, the one with
    the longest text wins (the earlier one of equal length).
    """
    host, path = host_and_path(F.col("url"))
    domain, suffix = levels(F.col("host"))
    placed = stored(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    seen = outcomes.filter(F.col("url").isNotNull() & F.col("good").isNotNull()).select(host.alias("host"), F.col("good").cast("int").alias("good"))
    with_levels = lambda df: df.withColumns({"domain": domain, "suffix": suffix})
    hosts = stored(reputation(with_levels(placed.select("host").distinct()), with_levels(seen)), "reputation")
    fitting, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(str(r))):
        fits = r.fits(F.col("host"), F.col("path"))
        fitting, verdict = F.when(fits, str(r)).otherwise(fitting), F.when(fits, r.verdict).otherwise(verdict)
    own = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    return placed.join(hosts, "host").select(
        "page_id", "host", "path", fitting.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mean", "upper")
