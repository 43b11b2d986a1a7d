"""Append-only versions, leases and retention. 'Now' is a parameter, so runs repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import read_table as T

#: Hours that finished work is kept, by class. Fixed values.
KEEP_HOURS = {"interactive": 24, "background": 720}
LEASE_SECONDS = 30
NOW = "2024-01-31 00:00:00"


def retained(df: DataFrame, group: str, ident: str, at: str, kind: Column, now: Column, keep_hours: dict[str, int] = KEEP_HOURS) -> DataFrame:
    """(ident, class, may_go): work may go when its class's hours are over, but the newest of each group always stays;
    classes without hours stay too."""
    hours = (F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 3_600_000_000
    newest = df.groupBy(group).agg(F.max_by(ident, F.struct(at, ident)).alias("__newest"))
    limit = F.lit(None).cast("int")
    for name, n in keep_hours.items():
        limit = F.when(F.col("class") == name, n).otherwise(limit)
    told = df.withColumn("class", kind).join(newest, group)
    return told.select(ident, "class", (F.coalesce(hours >= limit, F.lit(False)) & (F.col(ident) != F.col("__newest"))).alias("may_go"))


def retention_plan(spark, sf):
    """Events as work of their users: clicks and views are interactive, the rest runs in the background."""
    kind = F.when(F.col("event_type").isin("click", "view"), "interactive").otherwise("background")
    return retained(T(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "event_id", "ts", kind, F.lit(NOW).cast("timestamp"))


def lease_fold(events: DataFrame, key: str, at: str, ident: str, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Claims in order: one that comes within the lease of the one before renews it, a later one takes over with the
    next epoch."""
    w = Window.partitionBy(key).orderBy(at, ident)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.lag(F.unix_micros(F.col(at).cast("timestamp"))).over(w)
    taken = events.withColumn("__new", F.when(gap <= lease_seconds * 1_000_000, 0).otherwise(1))
    return taken.select(key, ident, F.sum("__new").over(w).alias("epoch"), (F.col("__new") == 1).alias("takeover"))


def lease_epochs(spark, sf):
    return lease_fold(T(spark, sf, "events"), "user_id", "ts", "event_id", 3600)


def append_next_revision(spark, sf):
    """New orders get the revisions after their customer's highest."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    old, new = o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 4 = 0")
    top = old.groupBy("o_custkey").agg(F.count("*").alias("top"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return new.join(top, "o_custkey", "left").select("o_custkey", "o_orderkey", (F.coalesce("top", F.lit(0)) + n).cast("bigint").alias("revision"))


def current_or_pinned(spark, sf):
    """A customer's pinned order if there is one, else the newest."""
    o = T(spark, sf, "orders")
    per = o.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))).alias("pinned"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))
    return per.select("o_custkey", F.coalesce("pinned", "newest").alias("o_orderkey"), F.col("pinned").isNotNull().alias("is_pinned"))


QUERIES = {f.__name__: f for f in (retention_plan, lease_epochs, append_next_revision, current_or_pinned)}
ORACLES = {
    "retention_plan": f"""WITH e AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'interactive' ELSE 'background' END AS class, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000.0 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
        SELECT event_id, class, h >= CASE class WHEN 'interactive' THEN 24 ELSE 720 END AND k > 1 AS may_go FROM e WHERE user_id IS NOT NULL""",
    "lease_epochs": """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events)
        SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS epoch, new = 1 AS takeover FROM g""",
    "append_next_revision": "WITH t AS (SELECT o_custkey, count(*) AS top FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1) SELECT o.o_custkey, o_orderkey, coalesce(top, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) AS revision FROM orders o LEFT JOIN t ON o.o_custkey = t.o_custkey WHERE o_orderkey % 4 = 0",
    "current_or_pinned": "WITH p AS (SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) AS pinned FROM orders GROUP BY 1), n AS (SELECT o_custkey, o_orderkey AS newest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1) SELECT o_custkey, coalesce(pinned, newest) AS o_orderkey, pinned IS NOT NULL AS is_pinned FROM p JOIN n USING (o_custkey)",
}
