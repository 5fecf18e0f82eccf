"""URL filters: rules first, then path templates per host that are rejected by the share of blocked pages they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import require_columns, stage

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# A node with more different branches than this, most of them rare, holds a variable segment.
MANY, RARE = 20, 2
SIMILAR_Z = 1.96
# Rows' worth of the parent's share that a node starts with, and the share from which a template is rejected.
SMOOTHING, REJECT = 5.0, 0.75
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def shape_of(segment: Column) -> Column:
    """A segment with its variable parts generalised: long hexadecimal names, then numbers."""
    return F.regexp_replace(F.regexp_replace(segment, r"[0-9a-f]{8,}(-[0-9a-f]{4,})*", "#"), r"[0-9]+", "#")


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; null if none does."""
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.when(fits, rule_host + rule_path).otherwise(named)
        verdict = F.when(fits, kind).otherwise(verdict)
    return named, verdict


def _merge_similar(children: DataFrame) -> DataFrame:
    """Give branches of a node that are statistically alike one name.

    Rare branches of a node with many become the wildcard. The others are ordered by their share of blocked pages; a
    branch joins the one before it unless the shares differ by more than ``SIMILAR_Z`` standard errors. Branches
    without labels have nothing to compare and stay apart.
    """
    node = Window.partitionBy("host", "prefix")
    seen = (
        children.groupBy("host", "prefix", "segment")
        .agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    )
    branches = seen.groupBy("host", "prefix").agg(
        F.count("*").alias("branches"), F.sum((F.col("n") <= RARE).cast("long")).alias("rare")
    )
    variable = (F.col("branches") > MANY) & (2 * F.col("rare") > F.col("branches")) & (F.col("n") <= RARE)
    general = seen.join(branches, ["host", "prefix"]).withColumn(
        "general", F.when(variable, "*").otherwise(F.col("segment"))
    )
    grouped = general.groupBy("host", "prefix", "general").agg(
        F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
    )
    share = F.col("blocked") / F.col("labelled")
    order = node.orderBy(share, "general")
    before = lambda name: F.lag(name).over(order)
    pooled = (F.col("blocked") + before("blocked")) / (F.col("labelled") + before("labelled"))
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / F.col("labelled") + 1 / before("labelled")))
    apart = F.abs(share - before("blocked") / before("labelled")) > SIMILAR_Z * error
    labelled = (
        grouped.filter("labelled > 0")
        .withColumn("cluster", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("cluster", F.sum("cluster").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    names = labelled.groupBy("host", "prefix", "cluster").agg(
        F.min("general").alias("least"), F.count("*").alias("size")
    )
    merged = labelled.join(names, ["host", "prefix", "cluster"]).select(
        "host", "prefix", "general", F.when(F.col("size") > 1, F.concat(F.lit("~"), "least")).otherwise(F.col("least")).alias("name")
    )
    return general.join(merged, ["host", "prefix", "general"], "left").select(
        "host", "prefix", "segment", F.coalesce("name", "general").alias("name")
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of every path shape in pages (host, shape, verdict of the rules).

    ``purity`` is the share of blocked pages among those that rules judge, smoothed towards the parent's from the
    root of all hosts down. Pages are summed by shape before any tree is built, so a host or path that holds many
    rows is one row here. Each level is stored.
    """
    count = lambda c: F.sum(c.cast("long"))
    shapes = stage(
        pages.groupBy("host", "shape").agg(
            F.count("*").alias("n"),
            count(F.col("verdict").isNotNull()).alias("labelled"),
            count(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("blocked"),
        ),
        "url-shapes",
    )
    parts = F.filter(F.split("shape", "/"), lambda s: s != "")
    total = shapes.agg(F.sum("labelled"), F.sum("blocked"), F.max(F.size(parts))).first()
    base = ((total[1] or 0) + 0.25 * SMOOTHING) / ((total[0] or 0) + SMOOTHING)

    def smoothed(rows: DataFrame, parent: Column) -> DataFrame:
        sums = rows.groupBy("host", "prefix").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        share = (F.col("b") + SMOOTHING * parent) / (F.col("l") + SMOOTHING)
        return rows.join(sums, ["host", "prefix"]).withColumn("purity", share).drop("l", "b")

    now = shapes.withColumn("parts", parts).withColumn("prefix", F.lit("")).withColumn("purity", F.lit(base))
    now = stage(smoothed(now, F.col("purity")), "url-level")
    for level in range(total[2] or 0):
        deeper = now.filter(F.size("parts") > level).withColumn("segment", F.get("parts", F.lit(level)))
        named = deeper.join(_merge_similar(deeper), ["host", "prefix", "segment"]).withColumn(
            "prefix", F.concat("prefix", F.lit("/"), "name")
        )
        grown = smoothed(named.drop("segment", "name"), F.col("purity"))
        now = stage(grown.select(*now.columns).unionByName(now.filter(F.size("parts") <= level)), "url-level")
    return now.select("host", "shape", F.col("prefix").alias("template"), "purity")


def judge(pages: DataFrame, rules: tuple = RULES, reject: float = REJECT) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    The longest fitting rule decides; a rule fits its host and all subdomains if the path starts with its own. Other
    pages are blocked where the smoothed share of blocked pages in their template is ``reject`` or more: the pages that
    rules judge are the labels. A null url, or one without ``://``, has empty host and path. Repeated rows are judged
    each, other columns are ignored, an empty table gives no rows.
    """
    require_columns(pages, "page_id", "url")
    url = F.coalesce("url", F.lit(""))
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    shape = F.array_join(F.transform(F.split("path", "/"), shape_of), "/")
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), shape.alias("shape"))
    judged = ruled.join(templates(ruled.select("host", "shape", "verdict")), ["host", "shape"])
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "purity")
