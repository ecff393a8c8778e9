"""URL filter by rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled outcomes of pages are counted by host, registered domain and suffix.
Each level's rate of bad pages is shrunk towards the level above through a
beta-binomial prior whose strength is fitted by moments to how far the level's
names differ among each other. A host's posterior gives a bound: pages are
blocked where the rate of bad pages is above the limit with high probability.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.session import materialise

#: Rules of the contract: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Suffixes of two labels, under which the registered domain has three.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A host is blocked where its rate of bad pages exceeds LIMIT at Z standard deviations under its posterior mean.
LIMIT = 0.2
Z = 1.645
#: Prior strengths stay between these, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, LOWER.upper(), LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of a host, or the last two of a known long suffix."""
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: one label before the suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule's name, its verdict) of the longest rule that fits, null without one."""
    ordered = sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)
    fits = [
        (((host == h) | host.endswith("." + h)) & path.startswith(p), h + p, verdict) for h, p, verdict in ordered
    ]
    none = F.lit(None).cast("string")
    name = functools.reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(fits), none)
    verdict = functools.reduce(lambda rest, r: F.when(r[0], r[2]).otherwise(rest), reversed(fits), none)
    return name, verdict


def strength(names: DataFrame, under: str) -> DataFrame:
    """``under, mean, prior``: the pooled rate below a name and the pages its prior is worth.

    Moments of the beta-binomial over names with ``n`` pages of which ``bad`` are bad: what the
    rates differ beyond binomial noise is the prior's variance. A prior is never worth more pages
    than it comes from, so that hosts without evidence anywhere have a wide posterior.
    """
    sums = names.groupBy(under).agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("spread"),
    )
    mean = (F.col("bad") + 1) / (F.col("n") + 2)
    noise = mean * (1 - mean)
    between = (F.col("spread") - F.col("n") * mean * mean - (F.col("k") - 1) * noise) / (F.col("n") - F.col("nn") / F.col("n"))
    prior = F.when((F.col("k") > 1) & (between > 0), noise / between - 1).otherwise(F.lit(STRONGEST))
    prior = F.least(F.greatest(prior, F.lit(WEAKEST)), F.lit(STRONGEST), F.col("n") + 2)
    return sums.select(under, "n", "bad", mean.alias("mean"), prior.alias("prior"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``host, alpha, beta`` of the posterior rate of bad pages, from rows of ``host, n, bad``.

    Every host has a row, those without labelled pages (n = 0) the prior of their domain.
    """
    hosts = outcomes.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"))
    seen = hosts.filter("n > 0")
    domains = strength(seen, "domain").select("domain", "n", "bad", F.col("prior").alias("host_prior"))
    domains = domains.withColumn("suffix", suffix_of(F.col("domain")))
    suffixes = strength(domains, "suffix").select(
        "suffix", "n", "bad", F.col("prior").alias("domain_prior"), F.lit(0).alias("all")
    )
    total = strength(suffixes, "all").select("all", F.col("mean").alias("all_mean"), F.col("prior").alias("suffix_prior"))
    suffixes = suffixes.join(F.broadcast(total), "all")
    suffix_mean = (F.col("bad") + F.col("all_mean") * F.col("suffix_prior")) / (F.col("n") + F.col("suffix_prior"))
    suffixes = suffixes.select("suffix", suffix_mean.alias("suffix_mean"), "domain_prior")
    domains = domains.join(suffixes, "suffix")
    domain_mean = (F.col("bad") + F.col("suffix_mean") * F.col("domain_prior")) / (F.col("n") + F.col("domain_prior"))
    domains = domains.select("domain", domain_mean.alias("domain_mean"), "host_prior")
    out = hosts.withColumn("suffix", suffix_of(F.col("domain"))).join(domains, "domain", "left").join(suffixes, "suffix", "left")
    mean = F.coalesce("domain_mean", "suffix_mean", F.lit(0.5))
    prior = F.coalesce("host_prior", "domain_prior", F.lit(WEAKEST))
    return out.select(
        "host",
        (F.col("bad") + mean * prior).alias("alpha"),
        (F.col("n") - F.col("bad") + (1 - mean) * prior).alias("beta"),
    )


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Mean less ``z`` standard deviations of the posterior."""
    total = alpha + beta
    return alpha / total - z * F.sqrt(alpha * beta / (total * total * (total + 1)))


def filter_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label: str = "quality") -> DataFrame:
    """Verdict for every page: the longest rule's, else by the reputation of its host.

    ``labels`` rates pages by ``doc_id`` (0 is bad). Returns ``page_id, host, path, rule, verdict`` and
    ``bad_rate_bound``. A null URL or one without ``://`` has empty host and path and is judged like a host
    named so. Pages of a repeated or null id are judged one by one; labels without id or value don't count,
    of several for an id the lowest does. Other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("u"))
    rows = rows.select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    outcomes = rows.join(known, F.col("page_id").cast("long") == F.col("id"), "left")
    outcomes = outcomes.groupBy("host").agg(
        F.count("y").alias("n"), F.coalesce(F.sum((F.col("y") == 0).cast("long")), F.lit(0)).alias("bad")
    )
    known_hosts = materialise(host_reputation(materialise(outcomes, "outcomes")), "reputation")
    bound = lower_bound(F.col("alpha"), F.col("beta"))
    judged = known_hosts.select("host", bound.alias("bad_rate_bound"))
    name, verdict = rule_of(F.col("host"), F.col("path"))
    by_host = F.when(F.col("bad_rate_bound") > LIMIT, "block").otherwise("allow")
    return rows.join(judged, "host").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bad_rate_bound"
    )
