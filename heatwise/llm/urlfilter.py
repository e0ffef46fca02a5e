"""URL rules by host-suffix and path-prefix expressions, DataFrame functions only.

A rule (host, path, verdict) fits the host itself and all its subdomains if the URL's path
starts with the rule's path; the rule with the longest host wins, then the longest path,
then ``block``.  Rule paths are empty or end with ``/``.

Every URL is first cut to the labels and path segments that any rule can reach (two numbers
taken from the rules; nothing deeper can match).  URLs that share this head are judged once:
heads are grouped with map-side combining, so a host with a third of all URLs is a few rows.
Each head is expanded into its expressions, joined to the rules on the first 32 bits of the
expression's SHA-256, confirmed on the whole digest, and the best rule is joined back; the
join back is an equi-join whose large keys adaptive execution splits.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule;
no rule or an empty rule table gives the default verdict; repeated rows stay; other columns
are carried only if named in ``keep``.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

RULES_SCHEMA = "host string, path string, verdict string"
_PREFIX_HEX = 8          # 32 bits


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(" ", host, path), 256)


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = (),
          default: str = "allow") -> DataFrame:
    """``keep`` columns plus host, path, rule (its host and path, else null), verdict."""
    known = rules.select("host", "path", "verdict").where("host is not null and verdict is not null")
    known = known.withColumn("path", F.coalesce("path", F.lit("")))
    labels, segments, odd = known.agg(
        F.max(F.size(F.split("host", r"\."))), F.max(F.size(F.split("path", "/"))),
        F.count(F.when(~(F.col("path").endswith("/") | (F.col("path") == "")), 1))).first()
    if odd:
        raise ValueError(f"{odd} rule paths neither are empty nor end with '/'")
    labels, segments = labels or 1, max((segments or 1) - 1, 1)

    parts = urls.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    host_parts = F.split("host", r"\.")
    path_parts = F.split("path", "/", segments + 1)     # the last one holds the unread rest
    tail = F.substring_index("host", ".", -labels)
    head = F.array_join(F.slice(path_parts, 1, F.least(F.size(path_parts) - 1, F.lit(segments))), "/")
    parts = parts.withColumns({"_tail": tail, "_head": F.when(F.size(path_parts) > 1, F.concat(head, F.lit("/")))
                               .otherwise(F.lit(""))})

    heads = parts.select("_tail", "_head").where("_tail != ''").distinct()
    host_parts, path_parts = F.split("_tail", r"\."), F.split("_head", "/")
    count = F.size(host_parts)
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(host_parts, count - i + 1, i), "."))
    whole = F.size(path_parts) - 1
    prefixes = F.when(whole < 1, F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.greatest(whole, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(path_parts, 1, i), "/"), F.lit("/")))))
    expressions = (heads.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes))
                   .withColumn("digest", _digest(F.col("h"), F.col("p")))
                   .withColumn("short", F.substring("digest", 1, _PREFIX_HEX)))
    listed = known.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, _PREFIX_HEX).alias("short"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(F.length("host").alias("a"), F.length("path").alias("b"), F.col("verdict"),
                 F.concat("host", "path").alias("rule")).alias("rank"))
    best = (expressions.join(listed, "short").where("digest = rule_digest")
            .groupBy("_tail", "_head").agg(F.max("rank").alias("_best")))
    return (parts.join(best, ["_tail", "_head"], "left")
            .select(*keep, "host", "path", F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))
