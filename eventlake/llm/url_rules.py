"""URL filter: the longest block or allow rule of every page, by a sort-merge range join.

Hosts are turned round label by label, so ``a.example.net`` becomes ``net.example.a``. A rule
``(host, path)`` covers its host and all subdomains; a page therefore stands once per level of its
host (``net``, ``net.example``, ``net.example.a``), each followed by its path. In these keys a
rule is a plain prefix, that is an interval of the sorted keys, and two intervals either nest or
do not touch. Rules and pages are range-partitioned together by key and swept in order: every
row sees the rule that started last, together with the stack of rules that rule lies in. All rules
that cover the row are on that stack, so popping those that do not leaves the covering ones.

The sweep carries the stack over partition borders through one row per partition. A host that
holds much of the data is cut by its paths; repeated addresses are swept once.

Cases: a null address, or one without ``://``, has an empty host and path and meets no rule. Of two
rules of one length the one with the longer host wins. Repeated rules count once, rules with a
null field are void. Every input row gives one row, an empty table gives none; further columns of
the pages are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.llm.columns import ascii_lower
from eventlake.session import pinned

# Rules of the query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule key with the rules it lies in, itself included."""
    known = (
        rules.dropna(subset=["host", "path", "verdict"])
        .select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .withColumn("key", F.concat(reversed_host(F.col("host")), F.col("path")))
        .groupBy("key")
        .agg(F.min(F.struct("host", "path", "verdict")).alias("rule"))
    )
    heads = known.select(
        "key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", 1, n))).alias("head")
    )
    outer = known.select(F.col("key").alias("head"), F.struct("key", "rule.*").alias("entry"))
    return heads.join(outer, "head").groupBy("key").agg(F.collect_list("entry").alias("stack"))


def matched_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of every distinct (host, path) that has one: host, path, rule, verdict."""
    labels = F.split(reversed_host(F.col("host")), r"\.")
    levels = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.concat_ws(".", F.slice(labels, 1, n)), F.col("path"))
    )
    pages = addresses.select("host", "path").distinct().select("host", "path", F.explode(levels).alias("key"))
    stacks = rule_stacks(rules)
    rows = pages.withColumns({"kind": F.lit(1), "stack": F.lit(None).cast(stacks.schema["stack"].dataType)}).unionByName(
        stacks.withColumns({"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string"), "kind": F.lit(0)})
    )
    ranged = pinned(rows.repartitionByRange("key", "kind", "host", "path").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("at_end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("at_end", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").join(carried, "part", "left")
    covering = F.filter(F.coalesce("stack", "carried"), lambda entry: F.startswith(F.col("key"), entry["key"]))
    won = swept.select("host", "path", F.explode(covering).alias("entry"))
    text = F.concat("entry.host", "entry.path")
    best = F.max(F.struct(F.length(text), F.length("entry.host"), text.alias("rule"), F.col("entry.verdict").alias("verdict")))
    return won.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``default`` is the verdict where no rule fits."""
    addressed = pages.select(
        F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    matched = matched_rules(addressed, rules)
    return addressed.join(matched, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""
