"""URL filters: a sort-merge range join of page keys with prefix rules.

A rule (host, path) holds for its host and all subdomains, on urls whose path starts with the
rule's path; the longest rule wins.  Canonical key of a rule: the host's labels in reverse
order, a slash (which no host contains), then the path (``com.example//en/``).  All keys that start with a rule's key form one
interval of the key order, and such intervals nest or are disjoint.  A page has one key per
enclosing domain (``com//en/7``, ``com.example//en/7`` ...), no more than the deepest rule has
labels.  Rules and page keys are sorted together; at every rule the sweep holds the stack of
rules that enclose it, a page key takes the stack of the last rule before it and pops the
rules whose interval has ended, and what is left on top is the longest rule of that domain.

The sweep is dealt into ``lanes`` by a hash of the page, each lane with all rules in order:
a hot host, url or rule spreads over all lanes, every lane sorts with spill, and nothing is
broadcast or collected (one number, the rules' largest label count, reaches the driver).
Built-in functions only.

Defined results: null url or one without ``://``: host and path empty, no rule, default
verdict.  Repeated rows are kept.  Of rules with equal host and path the greatest verdict
(``block`` over ``allow``) counts; rules with a null host or verdict, or a host with
``/``, ``?`` or ``#``, are ignored, a null path is empty.  Rules of equal length: the longer host, then the greater text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "[.]"))


def _key(labels: str, path: str) -> Column:
    return F.expr(f"concat(array_join({labels}, '.'), '/', {path})")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Rules with their key and the stack of rules that enclose them, shortest first, themselves
    last.  The enclosing rules are found by an equality join on the prefixes of the path."""
    r = (rules.where("host IS NOT NULL AND verdict IS NOT NULL AND NOT host RLIKE '[/?#]'")
         .select(F.translate("host", UPPER, UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                 "verdict")
         .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    prefixes = r.select("host", "path", F.explode(F.expr(
        "transform(sequence(0, length(path)), i -> left(path, i))")).alias("up"))
    up = r.select("host", F.col("path").alias("up"), F.struct(
        (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("hn"),
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"),
        _key("reverse(split(host, '[.]'))", "path").alias("key")).alias("e"))
    return (prefixes.join(up, ["host", "up"]).groupBy("host", "path")
            .agg(F.sort_array(F.collect_list("e")).alias("stack"))
            .select(_key("reverse(split(host, '[.]'))", "path").alias("key"), "stack",
                    F.size(_labels(F.col("host"))).alias("depth")))


def url_filter(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               default: str = "allow", lanes: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacks = rule_stacks(rules)
    depth = max(1, stacks.agg(F.max("depth")).first()[0] or 1)

    p = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    lane = F.pmod(F.xxhash64("page_id", "url"), F.lit(lanes)).cast("int")
    keys = (p.select("page_id", "url", lane.alias("lane"), _labels(url_host(F.col("url"))).alias("ls"),
                     url_path(F.col("url")).alias("path"))
            .select("page_id", "url", "lane", "ls", "path",
                    F.explode(F.expr(f"sequence(1, least(size(ls), {depth}))")).alias("labels"))
            .select("lane", _key("slice(ls, 1, labels)", "path").alias("key"),
                    F.lit(1).alias("kind"), "page_id", "url", "labels",
                    F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")))
    marks = stacks.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "key",
                          F.lit(0).alias("kind"), F.lit(None).cast(p.schema["page_id"].dataType).alias("page_id"),
                          F.lit(None).cast("string").alias("url"), F.lit(0).alias("labels"), "stack")
    sweep = Window.partitionBy("lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (keys.unionByName(marks).withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
             .where("kind = 1")
             .select("page_id", "url", "labels",
                     F.expr("try_element_at(filter(open, e -> startswith(key, e.key)), -1)").alias("top")))
    # Identical rows of the input meet again here: the one-label key of each copy counts it.
    best = (swept.groupBy("page_id", "url")
            .agg(F.sum(F.when(F.col("labels") == 1, 1).otherwise(0)).alias("copies"), F.max("top").alias("top")))
    out = best.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                      F.col("top.rule").alias("rule"),
                      F.coalesce("top.verdict", F.lit(default)).alias("verdict"),
                      F.expr("sequence(1, copies)").alias("c"))
    return out.select(F.explode("c").alias("c"), "page_id", "host", "path", "rule", "verdict").drop("c")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op10_url_filter(spark, sf_dir):
    return url_filter(pick(table(spark, sf_dir, "pages"), "page_id", "url"), rules_frame(spark))


def oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH r(rh, rp, v) AS (VALUES {values}),
p AS (SELECT row_number() OVER () AS rid, page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT rid, max(row(length(rh || rp), length(rh), rh || rp, v)) AS b
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, b[3] AS rule, coalesce(b[4], 'allow') AS verdict FROM p LEFT JOIN m USING (rid)"""


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": oracle()}
