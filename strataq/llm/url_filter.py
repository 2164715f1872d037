"""URL rules and empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk through beta-binomial
priors: the suffix's posterior is the prior of its registered domains, a
domain's that of its hosts.  At each level the prior strength is a parameter-
free moment estimate of how much the units below differ, within given bounds.
A host is blocked when its posterior is bad with the asked certainty: when the
upper bound of its good rate (posterior mean and z deviations of the beta, within
0 and 1) is below the cut-off.

Defined results: a null url, or one without '://', has an empty host and path,
no rule, and the verdict of the global prior.  Outcomes that are null count as
unlabelled; repeated label rows of one page each count once as given.  Extra
columns are ignored.  An empty table gives an empty result; with no labels the
global prior is prior_good.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Second-level labels under which registrants sit, e.g. example.co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def url_host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end; A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column) -> Column:
    """The last two labels, or three under a two-letter suffix with a SECOND_LEVEL label; port dropped."""
    parts = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(parts)
    deep = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    take = F.when(deep, 3).otherwise(F.least(n, F.lit(2)))
    return F.array_join(F.slice(parts, n - take + 1, take), ".")


def suffix(domain: Column) -> Column:
    """What follows the first label of a registered domain; a bare label is its own suffix."""
    return F.when(F.locate(".", domain) > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls.

    rules: (verdict, host, path prefix).  A rule fits its host and all subdomains.
    Equally long rules: the one that sorts first.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _strength(level: DataFrame, above: str, least: float, most: float) -> DataFrame:
    """Prior strength for units of `above`: moment estimate of a beta-binomial over the units below.

    s2 = sum n (r - m)^2 / sum n against m (1 - m); units without labels do not count.
    """
    sums = level.filter("n > 0").groupBy(above).agg(
        F.sum("n").cast("double").alias("_n"), F.sum("good").cast("double").alias("_g"), F.count(F.lit(1)).cast("double").alias("_k"),
        F.sum(F.round(F.col("good") * F.col("good") / F.col("n") * 1e6).cast("long")).cast("double").alias("_q"),
    )
    m = F.col("_g") / F.col("_n")
    between = (F.col("_q") / 1e6 - F.col("_n") * m * m) / F.col("_n")  # weighted variance of the units' rates
    within = m * (1 - m)
    mean_n = F.col("_n") / F.col("_k")
    rho = (between / within * mean_n - 1) / F.greatest(mean_n - 1, F.lit(1.0))  # intra-unit correlation
    k = F.when((F.col("_k") < 2) | (within <= 0) | (rho <= 0), F.lit(most)).otherwise(F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(least)), F.lit(most)))
    return sums.select(above, k.alias("_k"))


def host_reputation(outcomes: DataFrame, *, prior_good: float = 0.8, least: float = 2.0, most: float = 50.0, z: float = 1.645) -> DataFrame:
    """host -> n, good, post_mean, post_upper, post_lower.

    outcomes: host, good (0, 1 or null), one row per page.  All counts are taken
    over every row with map-side combination; one row per host leaves the shuffle.
    """
    labelled = F.col("good").isNotNull()
    hosts = cut(
        outcomes.groupBy("host").agg(F.sum(labelled.cast("long")).alias("n"), F.sum(F.coalesce(F.col("good").cast("long"), F.lit(0))).alias("good"))
        .withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain"))).withColumn("_all", F.lit(0)),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix", "_all").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix", "_all").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.groupBy("_all").agg(F.sum("n").alias("_tn"), F.sum("good").alias("_tg"))
    # one row; the global rate with one prior observation
    total = total.select("_all", ((F.col("_tg") + prior_good) / (F.col("_tn") + 1.0)).alias("_m"))
    mean = lambda: (F.col("good") + F.col("_k") * F.col("_m")) / (F.col("n") + F.col("_k"))
    by_suffix = suffixes.join(F.broadcast(total), "_all").join(F.broadcast(_strength(suffixes, "_all", least, most)), "_all", "left").na.fill({"_k": most})
    by_suffix = by_suffix.select("suffix", mean().alias("_m"))
    by_domain = domains.join(by_suffix, "suffix").join(_strength(domains, "suffix", least, most), "suffix", "left").na.fill({"_k": most})
    by_domain = by_domain.select("domain", mean().alias("_m"))
    posterior = hosts.join(by_domain, "domain").join(_strength(hosts, "domain", least, most), "domain", "left").na.fill({"_k": most})
    a, b = F.col("good") + F.col("_k") * F.col("_m"), F.col("n") - F.col("good") + F.col("_k") * (1 - F.col("_m"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return posterior.select("host", "n", "good", (a / (a + b)).alias("post_mean"), F.least(F.lit(1.0), a / (a + b) + z * sd).alias("post_upper"), F.greatest(F.lit(0.0), a / (a + b) - z * sd).alias("post_lower"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", cutoff: float = 0.5, **prior) -> DataFrame:
    """Per page: id, host, path, rule, verdict, post_upper.

    outcomes: (host, good), one row per labelled page: a repeated page id, on one host or several, is so many pages, each
    with its own outcome.  Rules decide first; the rest is allowed unless the host's posterior upper bound is below cutoff.
    """
    urls = pages.select(F.col(f"`{id_col}`").alias("_id"), url_host(F.col(f"`{url_col}`")).alias("host"), url_path(F.col(f"`{url_col}`")).alias("path"))
    known = urls.select("host", F.lit(None).cast("int").alias("good")).unionAll(outcomes.toDF("host", "good").select("host", F.col("good").cast("int")))
    reputation = cut(host_reputation(known.filter("host is not null"), **prior), "reputation")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("post_upper") < cutoff, "block").otherwise("allow")
    return urls.join(reputation.select("host", "post_upper"), "host", "left").select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, judged).alias("verdict"), F.round("post_upper", 6).alias("post_upper")
    )
