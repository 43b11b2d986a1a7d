"""Joins and set operations with the rules of versioned, reviewed data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.sweeps import overlap_pairs
from docloom.sources.tables import read_table as T
from docloom.sources.tables import tasks_for


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: a partial aggregate, so a key's rows are never gathered."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def latest_event_per_user(spark, sf):
    return latest_per_key(T(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, since: str, values: list[str]) -> DataFrame:
    """left with the newest right row of its key that is not later: both sides are sorted once and the values carried
    forward, so there is no join of all pairs. A key of very many rows is one window partition, streamed in order."""
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.struct(*values)
    a = left.select(key, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("__r"))
    b = right.select(key, F.col(since).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), carried.alias("__r"))
    both = a.unionByName(b).withColumn("__r", F.last("__r", True).over(w))
    return both.where("__side = 1").select("__l.*", *(F.col(f"__r.{v}").alias(f"{v}_asof") for v in values))


def asof_purchase_versions(spark, sf):
    ev = T(spark, sf, "events")
    left = ev.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = ev.where("event_type = 'click'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("click"))
    return asof_join(left, right, "user_id", "ts", "since", ["click"]).drop("ts")


def mutual_unique(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of rows whose key occurs once on each side; null keys never pair."""
    once = lambda df, c: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(c).alias(c)).where("n = 1").drop("n")
    ca, cb = (next(c for c in df.columns if c != key) for df in (a, b))
    return once(a, ca).join(once(b, cb), key)


def mutual_unique_alignment(spark, sf):
    bucket = lambda c: F.floor(F.col(c)).cast("bigint")
    a = T(spark, sf, "customer").select(bucket("c_acctbal").alias("k"), "c_custkey")
    b = T(spark, sf, "supplier").select(bucket("s_acctbal").alias("k"), "s_suppkey")
    return mutual_unique(a, b, "k")


def equal_sets(df: DataFrame, group: str, item: str) -> DataFrame:
    """Groups of two or more groups with the same set of items."""
    sets = df.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_set(item)), lambda x: x.cast("string")), ",").alias("items"))
    return sets.groupBy("items").agg(F.count("*").alias("n"), F.min(group).alias("first_group")).where("n > 1")


def set_equal_orders(spark, sf):
    return equal_sets(T(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones they do not replace."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def upsert_snapshot(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("N"))
    return upsert(o.where("o_orderkey % 2 = 0"), new, ["o_orderkey"])


def anti_unreferenced(spark, sf):
    return T(spark, sf, "customer").join(T(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


def semi_referenced(spark, sf):
    return T(spark, sf, "customer").join(T(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


def scalar_conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key: its value if all agree, else null and conflict; lowest and highest tell agreement, no set is built."""
    out = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    return out.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(value), (F.col("lo") != F.col("hi")).alias("conflict"), "n")


def part_conflicts(spark, sf):
    return scalar_conflicts(T(spark, sf, "part"), ["p_brand", "p_size"], "p_type")


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with one value only."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__hi")).where(F.col(value) == F.col("__hi")).drop("__hi")


def glossary_unambiguous(spark, sf):
    return unambiguous(T(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_brand", "p_size").alias("term"), "p_type"), "term", "p_type")


def interval_overlap_join(spark, sf):
    """Events of one user whose spans overlap, met by a sweep."""
    ev = T(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 60_000_000).cast("bigint") + 1).alias("e"))
    return overlap_pairs(ev, None, "user_id", "event_id", "s", "e")


def boxes_iou(boxes: DataFrame, page: str, ident: str, cell: int, least: float, tasks: int | None = None) -> DataFrame:
    """Pairs of boxes of a page whose intersection over union is at least `least`, met in grid cells. tasks: how many the
    cells are dealt to (`tasks_for`), else the session's number."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
    cut = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    if tasks:
        cut = cut.repartition(tasks, page, "cx", "cy")
    a, b = cut.alias("a"), cut.alias("b")
    c = lambda f, n: f(F.col(f"a.{n}"), F.col(f"b.{n}"))
    w, h = c(F.least, "x1") - c(F.greatest, "x0"), c(F.least, "y1") - c(F.greatest, "y0")
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    on = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col(f"a.{ident}") < F.col(f"b.{ident}")) & (w > 0) & (h > 0)
    here = (F.col("a.cx") == F.floor(c(F.greatest, "x0") / cell)) & (F.col("a.cy") == F.floor(c(F.greatest, "y0") / cell))
    iou = w * h / (area("a") + area("b") - w * h)
    return a.join(b, on & here & (iou >= least)).select(F.col(f"a.{page}").alias(page), F.col(f"a.{ident}").alias("a"), F.col(f"b.{ident}").alias("b"), F.round(iou, 6).alias("iou"))


def box_iou_pairs(spark, sf):
    x, y = F.col("p_partkey") * 7 % 90, F.col("p_partkey") * 13 % 90
    part = T(spark, sf, "part")
    boxes = part.select(F.floor(F.col("p_partkey") / 50).cast("bigint").alias("page"), F.col("p_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") + 5).alias("x1"), (y + F.col("p_size") + 5).alias("y1"))
    return boxes_iou(boxes, "page", "id", 32, 0.3, tasks_for(part, 50_000))  # a box is in some four cells


QUERIES = {f.__name__: f for f in (latest_event_per_user, asof_purchase_versions, mutual_unique_alignment, set_equal_orders, upsert_snapshot, anti_unreferenced, semi_referenced, part_conflicts, glossary_unambiguous, interval_overlap_join, box_iou_pairs)}
ORACLES = {
    "latest_event_per_user": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "asof_purchase_versions": "SELECT p.user_id, p.event_id, c.event_id AS click_asof FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "mutual_unique_alignment": "WITH a AS (SELECT floor(c_acctbal)::BIGINT AS k, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(*) = 1), b AS (SELECT floor(s_acctbal)::BIGINT AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT k, c_custkey, s_suppkey FROM a JOIN b USING (k)",
    "set_equal_orders": "SELECT items, count(*) AS n, min(l_orderkey) AS first_group FROM (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS items FROM lineitem GROUP BY 1) GROUP BY items HAVING count(*) > 1",
    "upsert_snapshot": "SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0",
    "anti_unreferenced": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "semi_referenced": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "part_conflicts": "SELECT p_brand, p_size, CASE WHEN min(p_type) = max(p_type) THEN min(p_type) END AS p_type, min(p_type) <> max(p_type) AS conflict, count(p_type) AS n FROM part GROUP BY p_brand, p_size",
    "glossary_unambiguous": "SELECT concat_ws('/', p_name, p_brand, p_size) AS term, min(p_type) AS p_type FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1",
    "interval_overlap_join": "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + floor(value * 60000000)::BIGINT + 1 AS e FROM events) SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e",
    "box_iou_pairs": """WITH q AS (SELECT (p_partkey // 50)::BIGINT AS page, p_partkey AS id, p_partkey * 7 % 90 AS x0, p_partkey * 13 % 90 AS y0, p_size + 5 AS d FROM part), b AS (SELECT *, x0 + d AS x1, y0 + d AS y1 FROM q),
        p AS (SELECT a.page, a.id AS a, b.id AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, a.d * a.d + b.d * b.d AS s FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
        SELECT page, a, b, round((w * h)::DOUBLE / (s - w * h), 6) AS iou FROM p WHERE w > 0 AND h > 0 AND (w * h)::DOUBLE / (s - w * h) >= 0.3""",
}
