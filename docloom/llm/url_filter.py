"""URL filter lists by expression lookup.

A URL's host is expanded to its suffixes of as many labels as rules have, and its
path to the prefixes of the lengths that rules use; each combination is one
expression, so what a URL expands to does not depend on its own length.
Expressions meet rules in an equi-join on a short prefix of their SHA-256; the
full digests confirm a meeting, and the longest rule wins (then the longer host,
then block over allow).  Distinct (host, path) pairs are judged once.

Defined results: a null URL or one without ``://`` has an empty host and path
and gets the default verdict; repeated URLs get equal rows; without rules all
get the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import ascii_lower, table

#: Hex digits of the digest that the join compares first.
SHORT = 8
#: Rules up to this many are broadcast (about 200 bytes each); beyond, the join shuffles.
BROADCAST_RULES = 100_000
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All (host suffix, path prefix) pairs, as an array of structs; labels and lengths: the numbers of them that rules have."""
    suffix = lambda n: F.when(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= n - 1, F.substring_index(host, ".", -n))
    suffixes = F.array_compact(F.array(*map(suffix, labels)) if labels else F.array().cast("array<string>"))
    fitting = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``; rules: host, path, verdict."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    forms = [rules.where("host is not null and path is not null").select(c.alias("n")).distinct().orderBy("n") for c in (F.size(F.split("host", r"\.")), F.length("path"))]
    labels, lengths = ([r.n for r in f.collect()] for f in forms)
    known = rules.select(F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")).where("rule is not null").withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    asked = urls.select("host", "path").distinct().select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("e"))
    asked = asked.withColumn("asked", F.sha2(F.concat("e.host", "e.path"), 256)).withColumn("short", F.substring("asked", 1, SHORT)).drop("e")
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict") == "block")
    judged = asked.join(known, "short").where("asked = digest").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("won"))
    return urls.join(judged, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT DISTINCT u.host, u.path, rule_host || rule_path AS rule, verdict
  FROM u, r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) AS k FROM fits)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN best b ON u.host = b.host AND u.path = b.path AND k = 1
"""
