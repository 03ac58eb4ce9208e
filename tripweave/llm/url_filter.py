"""URL filtering by rules and empirical-Bayes host reputation.

Labelled page outcomes are summed per host. Each level shrinks toward the one
above through a beta-binomial prior: host toward registered domain, domain
toward suffix, suffix toward the global rate. The prior strength of a level is
a moment estimate from the spread of its groups. A page is blocked when the
lower posterior bound of its host's rate of bad pages exceeds ``max_bad``. A
rule that fits overrides the reputation.

Defined results: a null url, or one without ``://``, has an empty host and
path, which form a host of their own; very long urls are taken whole; hosts
without labels take their domain's rate; with no labels at all every page is
allowed by the method; repeated ids give a row each and share the id's outcomes,
several outcomes of one id all count; rules that tie in length are tried in the
order of their text, the last wins; an empty table gives an empty result; only id
and url are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import cut

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.in", "co.jp", "co.kr", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr")
#: Fixed values: (verdict, host, path prefix) of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
Z, MAX_BAD = 1.645, 0.2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does. Rules are a list of the caller, tried longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Moment estimate of a level's prior strength, between 1 and 1000, and the rate of all."""
    g = groups.agg(
        F.sum("n").alias("n"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"), F.count("*").alias("j"),
    ).filter("n > 0")
    p = F.col("b") / F.col("n")
    spread = F.col("bb") - F.col("b") * p - (F.col("j") - 1) * p * (1 - p)
    scale = F.col("n") - F.col("nn") / F.col("n")
    var = F.when(scale > 0, spread / scale)
    k = F.when(var > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), p * (1 - p) / var - 1))).otherwise(1000.0)
    row = g.select(k, p).first()
    return tuple(row) if row else (1.0, 0.0)


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``hosts`` (host, domain, suffix, n, bad) with p_bad and its lower bound."""
    by = {"host": hosts.filter("n > 0").select("host", "domain", "suffix", "n", "bad")}
    by["domain"] = by["host"].groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by["suffix"] = by["domain"].groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (k_suffix, p_all), (k_domain, _), (k_host, _) = (_strength(by[level]) for level in ("suffix", "domain", "host"))
    shrunk = lambda prior, k: (F.col("bad") + k * prior) / (F.col("n") + k)
    suffix = by["suffix"].select("suffix", shrunk(F.lit(p_all), k_suffix).alias("p_suffix"))
    domain = by["domain"].join(suffix, "suffix").select("domain", shrunk(F.col("p_suffix"), k_domain).alias("p_domain"))
    out = hosts.join(domain, "domain", "left").join(suffix, "suffix", "left")
    prior = F.coalesce("p_domain", "p_suffix", F.lit(p_all))
    out = out.withColumn("p_bad", shrunk(prior, k_host)).withColumn("_n", F.col("n") + k_host)
    return out.withColumn("bound", F.col("p_bad") - Z * F.sqrt(F.col("p_bad") * (1 - F.col("p_bad")) / (F.col("_n") + 1))).drop("_n", "p_domain", "p_suffix")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: id, host, path, rule, verdict, p_bad, bound.

    ``outcomes`` has (id, bad): one row per labelled page, bad 0 or 1.
    """
    slim = cut(pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")))
    marks = outcomes.filter("id IS NOT NULL").groupBy("id").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    per_host = slim.join(marks, "id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = cut(per_host.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    judged = slim.join(host_reputation(hosts).select("host", "p_bad", "bound"), "host")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_bad", "bound")
