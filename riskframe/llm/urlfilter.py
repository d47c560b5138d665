"""URL rules indexed by their rarest literal token.

A rule is ``host/path``: it fits its host and all subdomains when the URL's path
starts with the rule's path.  Each rule is filed under one of its literal
tokens (host labels, whole path segments), the one that the fewest URLs carry.
A URL fetches candidate rules by its own tokens and runs the regular
expressions of these candidates only; the longest fitting rule decides.

Cases: a null URL or one without ``://`` has an empty host and path and no
rule; rules of one length that fit the same URL have equal hosts and paths;
repeated rules count once; without any rule every URL gets the default verdict.
Every distinct URL is judged once, so a URL on a third of the rows costs one
judgement.  Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import col, fresh_name

DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast (a few hundred bytes each); more are joined.
BROADCAST_RULES = 100_000


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Text after the host up to ``?`` or ``#``."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, segments: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(segments, lambda x: x != ""),
                        lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, parts))


def _quoted(x: Column) -> Column:
    """A literal inside a regular expression: \\Q...\\E, with \\E itself split."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def compile_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule, verdict, on_host, on_path, size) of ``rules`` (rule,
    verdict), each under its rarest token among ``urls`` (host, path)."""
    slash = F.instr("rule", "/")
    parts = (rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
             .withColumn("slash", F.when(slash > 0, slash).otherwise(F.length("rule") + 1))
             .withColumn("r_host", F.translate(F.expr("substring(rule, 1, slash - 1)"), UPPER, LOWER))
             .withColumn("r_path", F.expr("substring(rule, slash, length(rule))")))
    segments = F.split("r_path", "/")
    whole = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    on_host = F.concat(F.lit(r"(?s)^(?:.*\.)?"), _quoted(F.col("r_host")), F.lit(r"\z"))
    on_path = F.concat(F.lit("^"), _quoted(F.col("r_path")))
    made = ["rule", "verdict", "on_host", "on_path", "size"]
    listed = parts.select("rule", "verdict", on_host.alias("on_host"), on_path.alias("on_path"),
                          F.length("rule").alias("size"),
                          F.explode(_tokens(F.col("r_host"), whole)).alias("token"))
    seen = (urls.select(F.explode(_tokens(F.col("host"), F.split("path", "/"))).alias("token"))
            .join(F.broadcast(listed.select("token").distinct()) if _small(listed)
                  else listed.select("token").distinct(), "token", "left_semi")
            .groupBy("token").agg(F.count("*").alias("n")))
    ranked = listed.join(seen, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    return (ranked.groupBy(*made).agg(rarest.alias("r"))
            .select(F.col("r.token").alias("token"), *made))


def _small(rules: DataFrame) -> bool:
    return len(rules.limit(BROADCAST_RULES + 1).select(F.lit(1)).take(BROADCAST_RULES + 1)) \
        <= BROADCAST_RULES


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url",
                default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` (null if none fits) and
    ``verdict``."""
    clash = {"host", "path", "rule", "verdict"} & {c.lower() for c in pages.columns}
    if clash:
        raise ValueError(f"the input already has the result columns {sorted(clash)}")
    key = fresh_name(pages, "the_url")
    urls = (pages.select(col(url).alias(key)).where(col(key).isNotNull()).distinct()
            .select(key, host_of(col(key)).alias("host"), path_of(col(key)).alias("path")))
    small = _small(rules)
    index = compile_rules(rules, urls)
    probes = urls.select(key, "host", "path",
                         F.explode(_tokens(F.col("host"), F.split("path", "/"))).alias("token"))
    hits = (probes.join(F.broadcast(index) if small else index, "token")
            .where(F.expr("rlike(host, on_host) and rlike(path, on_path)")))
    best = (hits.groupBy(key).agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
            .select(col(key), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    return (pages.withColumn(key, col(url)).join(best, key, "left")
            .select(*[col(c) for c in pages.columns], host_of(col(url)).alias("host"),
                    path_of(col(url)).alias("path"), "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
