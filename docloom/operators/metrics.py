"""Scores of extracted records against gold ones, and accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import read_table as T


def ratio(a: Column, b: Column) -> Column:
    """Null when there is nothing to divide by."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def with_scores(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn: f1 is null when all are zero and 0 when tp alone is."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(tp + fp + fn > 0, F.round(ratio(2 * tp, 2 * tp + fp + fn), 9))
    return df.withColumn("precision", F.round(ratio(tp, tp + fp), 9)).withColumn("recall", F.round(ratio(tp, tp + fn), 9)).withColumn("f1", f1)


def multiset_counts(gold: DataFrame, predicted: DataFrame, by: list[str], value: str, tasks: int | None = None) -> DataFrame:
    """Per value: true and false positives and false negatives as multisets, by one count over both sides. Null keys and
    values equal no others. tasks: how many the keys of `by` are dealt to (`tasks_for`), for keys with few rows each."""
    keys = [*by, value]
    alone = F.greatest(*(F.col(k).isNull() for k in keys))
    side = lambda df, name, g, p: df.select(*keys, F.when(alone, name).alias("__side"), F.lit(g).alias("g"), F.lit(p).alias("p"))
    rows = side(gold, "g", 1, 0).union(side(predicted, "p", 0, 1))
    rows = rows.repartition(tasks, *by) if tasks else rows
    both = rows.groupBy(*keys, "__side").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return both.select(*by, value, F.least("g", "p").alias("tp"), (F.col("p") - F.least("g", "p")).alias("fp"), (F.col("g") - F.least("g", "p")).alias("fn"))


def _gold_predicted(spark, sf):
    li = T(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_suppkey").alias("v"), "l_linenumber")
    keys = ["l_returnflag", "l_linestatus", "v"]
    return li.where("l_linenumber <> 1").select(*keys), li.where("l_linenumber <> 2").select("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") == 3, F.col("v") + 1).otherwise(F.col("v")).alias("v"))


def multiset_prf(spark, sf):
    gold, predicted = _gold_predicted(spark, sf)
    counts = multiset_counts(gold, predicted, ["l_returnflag", "l_linestatus"], "v")
    sums = counts.groupingSets([[], ["l_returnflag"], ["l_returnflag", "l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return with_scores(sums)


def review_effort(spark, sf):
    """What a reviewer would do: a wrong and a missing value of one field are an edit, the rest deletions and additions."""
    gold, predicted = _gold_predicted(spark, sf)
    per = multiset_counts(gold, predicted, ["l_returnflag", "l_linestatus"], "v").groupBy("l_returnflag", "l_linestatus").agg(F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    edits = F.least("fp", "fn")
    return per.select("l_returnflag", "l_linestatus", edits.alias("edits"), (F.col("fp") - edits).alias("deletions"), (F.col("fn") - edits).alias("additions"))


def block_f1(spark, sf):
    """Blocks (orders' sets of lines) that gold and prediction cut alike."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    block = lambda df: df.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_linenumber")), lambda x: x.cast("string")), ",").alias("lines"))
    gold, predicted = block(li).withColumn("g", F.lit(1)), block(li.where("l_returnflag <> 'R'")).withColumn("p", F.lit(1))
    both = gold.join(predicted, ["l_orderkey", "lines"], "full").fillna(0, ["g", "p"])
    sums = both.agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum(F.col("p") * (1 - F.col("g"))).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    return with_scores(sums)


def stage_costs_with_unknowns(spark, sf):
    """Per stage the sum of known costs, null if any is unknown, and how many are."""
    ev = T(spark, sf, "events").select("event_type", F.when(F.col("value") < 60, F.round(F.col("value") * 100).cast("bigint")).alias("cost"))
    return ev.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("cost").alias("known"), F.when(F.count("*") == F.count("cost"), F.sum("cost")).alias("total"), F.count_if(F.col("cost").isNull()).alias("unknown"))


def anchor_coverage(spark, sf):
    d, la = T(spark, sf, "documents").select("doc_id", "lang"), T(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(la, "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("covered"), F.sum("quality").alias("good"), F.round(ratio(F.count("quality"), F.count("*")), 9).alias("share"))


def project_summary(spark, sf):
    """Per customer: orders, lines, latest order; each side is summed before the join, so nothing multiplies."""
    o = T(spark, sf, "orders")
    lines = T(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    per = o.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"), F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("latest"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    return T(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(per, "c_custkey", "left").fillna(0, ["orders", "lines", "pending"])


def rolled_up(df: DataFrame, by: list[str], state: str, ranked: list[str]) -> DataFrame:
    """(by, state, n, and a count for each ranked state as n_<state>): the members' worst state, the first of ranked that
    any has; other states count as the last."""
    place = F.lit(len(ranked) - 1)
    for i, name in reversed(list(enumerate(ranked))):
        place = F.when(F.col(state) == name, i).otherwise(place)
    counts = (F.count_if(place == i).alias(f"n_{name}") for i, name in enumerate(ranked))
    out = df.groupBy(*by).agg(F.min(place).alias("__worst"), F.count("*").alias("n"), *counts)
    return out.withColumn("state", F.element_at(F.array(*map(F.lit, ranked)), F.col("__worst") + 1)).select(*by, "state", "n", *(f"n_{name}" for name in ranked))


def batch_rollup(spark, sf):
    """Per customer batch one state: failed beats running beats done; and how many of its orders are in each."""
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return rolled_up(T(spark, sf, "orders").withColumn("s", state), ["o_custkey"], "s", ["failed", "running", "done"])


_GP = """WITH li AS (SELECT l_returnflag, l_linestatus, l_suppkey AS v, l_linenumber AS n FROM lineitem),
    g AS (SELECT l_returnflag, l_linestatus, v, count(*) AS g FROM li WHERE n <> 1 GROUP BY ALL),
    p AS (SELECT l_returnflag, l_linestatus, CASE WHEN n = 3 THEN v + 1 ELSE v END AS v, count(*) AS p FROM li WHERE n <> 2 GROUP BY ALL),
    c AS (SELECT l_returnflag, l_linestatus, least(coalesce(g, 0), coalesce(p, 0)) AS tp, coalesce(p, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fp, coalesce(g, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fn FROM g FULL JOIN p USING (l_returnflag, l_linestatus, v))"""
_PRF = "round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1"
QUERIES = {f.__name__: f for f in (multiset_prf, review_effort, block_f1, stage_costs_with_unknowns, anchor_coverage, project_summary, batch_rollup)}
ORACLES = {
    "multiset_prf": _GP + f", s AS (SELECT l_returnflag, l_linestatus, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))) SELECT *, {_PRF} FROM s",
    "review_effort": _GP + ", s AS (SELECT l_returnflag, l_linestatus, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ALL) SELECT l_returnflag, l_linestatus, least(fp, fn) AS edits, fp - least(fp, fn) AS deletions, fn - least(fp, fn) AS additions FROM s",
    "block_f1": f"""WITH g AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
        s AS (SELECT count(*) FILTER (g.l_orderkey IS NOT NULL AND p.l_orderkey IS NOT NULL) AS tp, count(*) FILTER (g.l_orderkey IS NULL) AS fp, count(*) FILTER (p.l_orderkey IS NULL) AS fn FROM g FULL JOIN p ON g.l_orderkey = p.l_orderkey AND g.lines = p.lines) SELECT *, {_PRF} FROM s""",
    "stage_costs_with_unknowns": "WITH e AS (SELECT event_type, CASE WHEN value < 60 THEN round(value * 100)::BIGINT END AS cost FROM events) SELECT event_type, count(*) AS calls, sum(cost)::BIGINT AS known, CASE WHEN count(*) = count(cost) THEN sum(cost)::BIGINT END AS total, count(*) FILTER (cost IS NULL) AS unknown FROM e GROUP BY 1",
    "anchor_coverage": "SELECT lang, count(*) AS n, count(quality) AS covered, sum(quality)::BIGINT AS good, round(count(quality) / count(*), 9) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "project_summary": "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT o_custkey, count(*) AS orders, sum(coalesce(n, 0))::BIGINT AS lines, max(epoch_us(o_orderdate)) AS latest, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, c_mktsegment, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, latest, coalesce(pending, 0) AS pending FROM customer LEFT JOIN p ON o_custkey = c_custkey",
    "batch_rollup": "SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'running' ELSE 'done' END AS state, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_failed, count(*) FILTER (o_orderstatus = 'P') AS n_running, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS n_done FROM orders GROUP BY 1",
}
