"""URL filters by a sort-merge range join, in DataFrame functions only.

A host with its labels reversed ("org.example.m.") turns "this host and all its subdomains" into a prefix, and a
prefix into an interval of sorted keys. Such intervals nest or are disjoint. Points and intervals are sorted together;
the interval opened last before a point, with the intervals around it, is the stack of what may be active, and those
that still hold the point are kept. One sweep over hosts finds the rule hosts of each url, a second one over
(rule host, path) the longest path rule of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: (rule host, rule path, verdict) of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; null or without '://': empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; null or without '://': empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot: a subdomain's key begins with its parent's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def with_chains(intervals: DataFrame) -> DataFrame:
    """intervals (prefix, value), one row a prefix: adds chain, the interval and those around it, outermost first."""
    inner = intervals.select(F.col("prefix").alias("own"), F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("n")).select("own", F.expr("substring(own, 1, n)").alias("prefix"))
    return inner.join(intervals, "prefix").groupBy("own").agg(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "value"))).alias("chain")).withColumnRenamed("own", "prefix")


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (key, ...) with the column stack: the values of the intervals (prefix, value) that hold the key, outermost
    first, each with its prefix. Keys may be null (empty stack) and repeated; a row's place among equal keys is dealt
    by the hash of its other columns, so a very common key is spread over many partitions."""
    rest = [c for c in points.columns if c != "key"]
    chains = with_chains(intervals)
    kind = chains.schema["chain"].dataType
    opened = chains.select(F.col("prefix").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("deal"), "chain", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest))
    asked = points.select("key", F.lit(1).alias("kind"), F.xxhash64(*rest).alias("deal"), F.lit(None).cast(kind).alias("chain"), *rest)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = materialize(opened.union(asked).repartitionByRange(n, "key", "kind", "deal").withColumn("part", F.spark_partition_id()))
    # what was opened last in an earlier partition is still to be looked at; one row a partition
    ends = events.groupBy("part").agg(F.max_by("chain", F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    carried = ends.select("part", F.last("end", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    w = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.join(F.broadcast(carried), "part").repartitionByRange(n, "part").withColumn("open", F.coalesce(F.last("chain", True).over(w), F.col("carried")))
    stack = F.filter("open", lambda x: F.startswith(F.col("key"), x["prefix"]))
    return found.where("kind = 1").select("key", *rest, F.coalesce(F.when(F.col("key").isNotNull(), stack), F.array().cast(kind)).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row a page: page_id, host, path, rule (host and path of the longest fitting rule, else null), verdict.

    rules (host, path, verdict): fits a host and its subdomains if the url's path begins with the rule's. Longest: by
    the characters of host and path, then of the host; of equal rules block wins. A null url or one without '://' has
    an empty host and path, which no rule fits. Rules with a null part are left out; without rules every page gets
    the default. Repeated pages stay repeated; other columns are not read; an empty table gives an empty result.
    """
    plain = rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", _UP, _LOW).alias("host"), "path", "verdict")
    plain = plain.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = plain.select("host").distinct().select(host_key(F.col("host")).alias("prefix"), F.col("host").alias("value"))
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("uid", F.monotonically_increasing_id()).withColumn("key", host_key(F.col("host")))
    on_host = sweep(urls, hosts).drop("key")
    split = F.lit("\x00")
    asked = on_host.select("page_id", "host", "path", "uid", F.explode_outer("stack.value").alias("rule_host")).withColumn("key", F.concat("rule_host", split, "path"))
    paths = plain.select(F.concat("host", split, "path").alias("prefix"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict").alias("value"))
    best = sweep(asked, paths).select("uid", "page_id", "host", "path", F.array_max("stack.value").alias("best"))
    one = best.groupBy("uid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return one.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A short list of rules as a table, by SQL functions alone."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def _oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
    WITH rules(rh, rp, verdict) AS (VALUES {values}),
    u AS (SELECT page_id,
        CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UP}', '{_LOW}') ELSE '' END AS host,
        CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
    f AS (SELECT u.page_id, rh || rp AS rule, verdict,
        row_number() OVER (PARTITION BY u.page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, rh || rp DESC) AS k
        FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT u.page_id, host, path, f.rule, coalesce(f.verdict, '{DEFAULT}') AS verdict
    FROM u LEFT JOIN f ON u.page_id = f.page_id AND k = 1"""


QUERIES = {"op7_url_rules": op7_url_rules}
ORACLES = {"op7_url_rules": _oracle()}
