"""URL rules by hash prefix: a URL is expanded into host-suffix and path-prefix expressions, and these meet the rules.

Each distinct URL gives the expressions that some rule could equal: its host and every parent domain with as many labels as
a rule's host has, times the beginnings of its path as long as a rule's path. Expressions meet rules in an equality join on
the first four bytes of their SHA-256; the full digest confirms; of the rules that fit the longest wins, of equally long
ones the first in text order. Only what a rule matched is grouped again, and URLs that repeat are expanded once.

Results for odd input: a null URL, or one without "://", has an empty host and path; without a rule that fits, the verdict
is ``default`` and the rule null; repeated rows give repeated results; no rules or no pages give plain or no results; a rule
listed twice with different actions blocks; rules with null host or path are ignored; other columns are not read.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import LOWER, UPPER


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by position of the first "://" and the marks that end each."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _prefix(digest: str) -> Column:
    return F.substring(digest, 1, 4)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. rules: host, path, action (allow or block)."""
    listed = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy(
        F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("action").alias("action"))
    listed = listed.select("host", "path", "action", F.concat("host", "path").alias("rule"))
    # Distinct sizes of rules, not rules: both are bounded by the length of a URL.
    labels = sorted(r[0] for r in listed.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())
    lengths = sorted(r[0] for r in listed.select(F.length("path").alias("n")).distinct().collect())
    known = listed.select(F.unhex(F.sha2(F.concat_ws("\n", "host", "path"), 256)).alias("rule_digest"), "rule", "action")
    known = known.withColumn("prefix", _prefix("rule_digest"))

    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.filter(F.array(*[F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), n)))
                                  for n in labels] or [F.lit(None).cast("string")]), lambda h: h.isNotNull())
    begins = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
                      lambda p: p.isNotNull())
    expressions = urls.select("url", F.explode(suffixes).alias("h"), begins.alias("begins")).select("url", "h", F.explode("begins").alias("p"))
    expressions = expressions.select("url", F.unhex(F.sha2(F.concat_ws("\n", "h", "p"), 256)).alias("digest")).withColumn("prefix", _prefix("digest"))
    fits = expressions.join(known, "prefix").filter("digest = rule_digest")
    # Longest first, then text order: the smallest (-length, rule).
    best = fits.groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("order"), "rule", "action")).alias("best"))
    return pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(best, "url", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
