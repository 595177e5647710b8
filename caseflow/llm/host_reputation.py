"""URL filter by empirical-Bayes host reputation, in native expressions.

Labelled pages give every host a count of good and bad outcomes. The share of good pages of a host is
shrunk towards its registered domain's, that towards its suffix's, and that towards the share of all
labelled pages, each through a beta prior whose strength is fitted by the method of moments from how
much the groups of that level differ. A page is blocked where even the upper bound of its host's
posterior share of good pages is below the limit. Listed rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LIMIT, DEVIATIONS = 0.5, 1.0
WEAKEST, STRONGEST = 1.0, 1000.0


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label of the name; empty for a name without a dot, an address or no name."""
    name = F.regexp_replace(host, r"(^.*@)|(:[0-9]*$)", "")
    return F.when(name.rlike(r"^[0-9.]+$"), F.lit("")).otherwise(F.regexp_extract(name, r"[^.]\.([^.]+)\.?$", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of the name; the whole name where there is no suffix."""
    name = F.regexp_replace(host, r"(^.*@)|(:[0-9]*$)", "")
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)\.?$", 1)
    return F.when(name.rlike(r"^[0-9.]+$") | (two == ""), name).otherwise(two)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and starts the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, answer in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(answer)).otherwise(verdict)
    return rule, verdict


def _shrunk(groups: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Add ``mean`` and ``weight``: the posterior share of each group and the pages it rests on.

    ``groups`` has n and good, ``above`` the prior share for each value of ``key``.
    """
    rows = groups.join(above.select(key, F.col("mean").alias("prior")), key)
    noise = F.col("prior") * (1 - F.col("prior"))
    spread = F.sum(F.pow(F.col("good") - F.col("n") * F.col("prior"), 2) - F.col("n") * noise)
    rho = F.coalesce(F.try_divide(spread, F.sum(F.col("n") * (F.col("n") - 1) * noise)), F.lit(0.0))
    kappa = F.when(rho <= 0, F.lit(STRONGEST)).otherwise(
        F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.try_divide(1 - rho, rho)))
    )
    strength = rows.agg(F.coalesce(kappa, F.lit(STRONGEST)).alias("kappa"))
    total = F.col("n") + F.col("kappa")
    return rows.crossJoin(F.broadcast(strength)).select(  # one row
        *groups.columns, ((F.col("good") + F.col("kappa") * F.col("prior")) / total).alias("mean"), total.alias("weight")
    )


def reputation(urls: DataFrame) -> DataFrame:
    """(host, mean, weight) for every host of ``urls`` (host, good: 1, 0 or null where unlabelled)."""
    hosts = urls.groupBy("host").agg(
        F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good")
    )
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("all", F.lit(0))
    whole = suffixes.groupBy("all").agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("mean"))
    suffixes = _shrunk(suffixes, whole, "all")
    domains = _shrunk(domains, suffixes, "suffix")
    return _shrunk(hosts, domains, "domain").select("host", "mean", "weight")


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    limit: float = LIMIT,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (to six places).

    ``outcomes`` has page_id and good (1 or 0); nulls, other values and ids without a page count for
    nothing, and an id with several outcomes counts its mean. score is the upper bound of the host's
    posterior share of good pages: mean plus ``deviations`` standard deviations. A null url, or one
    without ``://``, has an empty host, which is judged like any other. Without outcomes every host
    rests on the prior 0.5 and is allowed. Repeated pages are judged each. An empty table gives no
    rows. Columns besides page_id and url are ignored.
    """
    named = outcomes.select(F.col("page_id").cast("bigint").alias("_id"), F.col("good").cast("double").alias("good"))
    named = named.where("good IN (0, 1)").groupBy("_id").agg(F.avg("good").alias("good"))
    urls = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        host_of(F.col("url").cast("string")).alias("host"),
        path_of(F.col("url").cast("string")).alias("path"),
    )
    known = reputation(urls.join(named, urls["page_id"] == named["_id"], "left").select("host", "good"))
    bound = F.col("mean") + deviations * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = urls.join(known.select("host", bound.alias("score")), "host")
    return rows.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") < limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round("score", 6).alias("score"),
    )
