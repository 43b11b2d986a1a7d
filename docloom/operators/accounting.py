"""Accounts of claims, rounds of scores side by side, and text seen twice by overlapping crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import fold_spaces
from docloom.operators.graph import components
from docloom.operators.metrics import _PRF, multiset_counts, with_scores
from docloom.sources.tables import read_table as T
from docloom.sources.tables import tasks_for
from docloom.sources.written import materialize

#: Reasons that leave a check not completed. Fixed values.
UNFINISHED = ("grounding_exceeds_budget", "call_failed", "missing_claim", "unknown_label", "no_evidence")
MIN_IOU = 0.5


def score_deltas(baseline: DataFrame, candidate: DataFrame, by: str) -> DataFrame:
    """How far precision, recall and f1 moved, per row of either side; null where a side has no score."""
    names = ("precision", "recall", "f1")
    side = lambda df, s: df.select(by, *(F.col(n).alias(f"{s}_{n}") for n in names))
    both = side(baseline, "b").join(side(candidate, "c"), by, "full")
    return both.select(by, *(F.round(F.col(f"c_{n}") - F.col(f"b_{n}"), 9).alias(f"{n}_delta") for n in names))


def judged_scores(cells: DataFrame, verdicts: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Scores per field where only cells (keys, field, tp, fp, fn) that are not exact need a verdict (keys, field, tp,
    fp, fn, uncertain): exact cells count as they are, the others by their verdict, and those without one are told
    apart as unjudged."""
    told = verdicts.select(*keys, field, *(F.col(c).alias(f"v_{c}") for c in ("tp", "fp", "fn", "uncertain")), F.lit(True).alias("told"))
    exact = (F.col("fp") == 0) & (F.col("fn") == 0)
    judged = exact | F.col("told").isNotNull()
    use = lambda c: F.coalesce(F.sum(F.when(exact, F.col(c)).when(F.col("told"), F.col(f"v_{c}"))), F.lit(0)).alias(c)
    sums = cells.join(told, [*keys, field], "left").groupBy(field).agg(
        use("tp"), use("fp"), use("fn"), F.coalesce(F.sum(F.when(~exact, F.col("v_uncertain"))), F.lit(0)).alias("uncertain"), F.count_if(judged).alias("judged"), F.count_if(~judged).alias("unjudged")
    )
    return with_scores(sums)


def grounding_account(claims: DataFrame, excluded: DataFrame, linked: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, name, n): every claim once as excluded, supported, not_completed or unsupported, with claims and eligible,
    the reasons of the not completed ones (each once a claim) and the policies of the excluded ones.

    excluded has a column policy, issues a column code; both and linked may hold rows of no claim and repeated rows.
    """
    mark = lambda df, c: df.select(*keys, F.lit(True).alias(c)).distinct()
    codes = issues.where(F.col("code").isin(*UNFINISHED)).groupBy(*keys).agg(F.collect_set("code").alias("codes"))
    policy = excluded.groupBy(*keys).agg(F.min("policy").alias("policy"))
    per = claims.select(*keys).distinct().join(policy, keys, "left").join(mark(linked, "linked"), keys, "left").join(codes, keys, "left")
    state = F.when(F.col("policy").isNotNull(), "excluded").when(F.col("linked"), "supported").when(F.col("codes").isNotNull(), "not_completed").otherwise("unsupported")
    told = per.select("policy", "codes", state.alias("state"))
    one = lambda kind, name: F.array(F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    none = F.lit(None).cast("array<struct<kind:string,name:string>>")
    rows = F.flatten(F.filter(F.array(
        one("total", F.lit("claims")), one("state", F.col("state")),
        F.when(F.col("state") == "excluded", one("policy", F.col("policy"))).otherwise(one("total", F.lit("eligible"))),
        F.when(F.col("state") == "not_completed", F.transform("codes", lambda x: F.struct(F.lit("reason").alias("kind"), x.alias("name")))).otherwise(none),
    ), lambda x: x.isNotNull()))
    return told.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.name").agg(F.count("*").alias("n"))


def duplicate_pairs(seen: DataFrame, least: float = MIN_IOU, cell: int = 32) -> DataFrame:
    """Pairs (a, b), a before b, of observations (place, id, crop, text, x0 to y1, cx0 to cy1) of one place and equal
    folded text whose boxes have an intersection over union of at least `least`, in different overlapping crops.

    They meet by place, text and the grid cells of their boxes, in the first cell they share.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
    cut = seen.withColumn("folded", F.xxhash64(fold_spaces(F.col("text")))).withColumn("text", fold_spaces(F.col("text")))
    cut = cut.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    a, b = cut.alias("a"), cut.alias("b")
    of = lambda f, n: f(F.col(f"a.{n}"), F.col(f"b.{n}"))
    width = lambda p, n: of(F.least, f"{p}{n}1") - of(F.greatest, f"{p}{n}0")
    w, h = width("", "x"), width("", "y")
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    on = F.lit(True)
    for n in ("place", "folded", "gx", "gy", "text"):
        on = on & (F.col(f"a.{n}") == F.col(f"b.{n}"))
    on = on & (F.col("a.id") < F.col("b.id")) & (F.col("a.crop") != F.col("b.crop")) & (width("c", "x") > 0) & (width("c", "y") > 0) & (w > 0) & (h > 0)
    for g, n in (("gx", "x0"), ("gy", "y0")):
        on = on & (F.col(f"a.{g}") == F.floor(of(F.greatest, n) / cell))
    return a.join(b, on & (w * h >= least * (area("a") + area("b") - w * h))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def duplicate_marks(pairs: DataFrame) -> DataFrame:
    """(id, first, members, mark) of every observation in a pair: first and number of its component, and 'kept' or
    'dropped' in a component of two, where the later one goes, 'potential' in a larger one, which stays whole."""
    label = components(pairs.select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"))).select("node", F.col("component").alias("least"))
    label = materialize(label)
    size = label.groupBy("least").agg(F.count("*").alias("members"))
    mark = F.when(F.col("members") > 2, "potential").when(F.col("node") == F.col("least"), "kept").otherwise("dropped")
    return label.join(size, "least").select(F.col("node").alias("id"), F.col("least").alias("first"), "members", mark.alias("mark"))


def _line_values(spark: SparkSession, sf: str, shift: int) -> tuple[DataFrame, DataFrame]:
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_suppkey").alias("v"), "l_linenumber")
    read = F.when(F.col("l_linenumber") == shift, F.col("v") + 1).otherwise(F.col("v")).alias("v")
    return li.where("l_linenumber <> 1").drop("l_linenumber"), li.where(F.col("l_linenumber") != shift - 1).select("l_orderkey", "l_returnflag", read)


def _cells(spark: SparkSession, sf: str, shift: int) -> DataFrame:
    per = multiset_counts(*_line_values(spark, sf, shift), ["l_orderkey", "l_returnflag"], "v", tasks_for(T(spark, sf, "lineitem")))
    return per.groupBy("l_orderkey", "l_returnflag").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def compared_rounds(spark, sf):
    """Two rounds of reading the same gold values; the candidate read no line with flag N."""
    score = lambda cells: with_scores(cells.groupBy("l_returnflag").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    return score_deltas(score(_cells(spark, sf, 3)), score(_cells(spark, sf, 2).where("l_returnflag <> 'N'")), "l_returnflag")


def judged_round(spark, sf):
    """Orders divisible by 3 have no verdict; of the others a judge accepts one wrong value and leaves one uncertain."""
    cells = _cells(spark, sf, 3)
    verdicts = cells.where("l_orderkey % 3 <> 0 and fp + fn > 0").selectExpr("l_orderkey", "l_returnflag", "tp + least(fp, fn, 1) AS tp", "fp - least(fp, fn, 1) AS fp", "fn - least(fp, fn, 1) AS fn", "if(l_orderkey % 2 = 0, 1L, 0L) AS uncertain")
    return judged_scores(cells, verdicts, ["l_orderkey"], "l_returnflag")


def claim_account(spark, sf):
    """Order lines as claims: untaxed ones are excluded, large ones linked, and parts stand for the issues' codes."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag")
    keys, named = ["l_orderkey", "l_linenumber"], F.array(*map(F.lit, (*UNFINISHED, "other", "late")))
    code = lambda c: F.element_at(named, (F.col(c) % 7 + 1).cast("int")).alias("code")
    issues = li.where("l_partkey % 2 = 0").select(*keys, code("l_partkey")).union(li.where("l_partkey % 4 = 0").select(*keys, code("l_suppkey")))
    return grounding_account(li, li.where("l_tax = 0").select(*keys, F.col("l_returnflag").alias("policy")), li.where("l_quantity > 25"), issues, keys)


def duplicate_components(spark, sf):
    """Order lines as observations: the part is the place, the line number the crop, the flags the text."""
    q, d = F.col("l_quantity").cast("bigint") * 2, F.round(F.col("l_discount") * 100).cast("bigint") * 3
    crop = F.col("l_linenumber").cast("bigint")
    seen = T(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("place"), (F.col("l_orderkey") * 8 + crop).alias("id"), crop.alias("crop"), F.concat("l_returnflag", F.lit("  "), "l_linestatus").alias("text"),
        q.alias("x0"), (q + 24).alias("x1"), d.alias("y0"), (d + 15).alias("y1"), (crop * 10).alias("cx0"), (crop * 10 + 25).alias("cx1"), F.lit(0).alias("cy0"), F.lit(1).alias("cy1"),
    )
    return duplicate_marks(duplicate_pairs(seen))


QUERIES = {f.__name__: f for f in (compared_rounds, judged_round, claim_account, duplicate_components)}


def _cells_sql(shift: int) -> str:
    return f"""SELECT coalesce(g.o, p.o) AS l_orderkey, coalesce(g.f, p.f) AS l_returnflag, sum(least(coalesce(g.n, 0), coalesce(p.n, 0))) AS tp, sum(greatest(coalesce(p.n, 0) - coalesce(g.n, 0), 0)) AS fp, sum(greatest(coalesce(g.n, 0) - coalesce(p.n, 0), 0)) AS fn
        FROM (SELECT l_orderkey AS o, l_returnflag AS f, l_suppkey AS v, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2, 3) g
        FULL JOIN (SELECT l_orderkey AS o, l_returnflag AS f, CASE WHEN l_linenumber = {shift} THEN l_suppkey + 1 ELSE l_suppkey END AS v, count(*) AS n FROM lineitem WHERE l_linenumber <> {shift - 1} GROUP BY 1, 2, 3) p ON g.o = p.o AND g.f = p.f AND g.v = p.v GROUP BY 1, 2"""


_ROUND = f"SELECT l_returnflag, tp, fp, fn, {_PRF} FROM (SELECT l_returnflag, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM"
_CODE = "['grounding_exceeds_budget', 'call_failed', 'missing_claim', 'unknown_label', 'no_evidence', 'other', 'late']"
ORACLES = {
    "compared_rounds": f"""WITH b AS ({_ROUND} ({_cells_sql(3)}) GROUP BY 1)), c AS ({_ROUND} ({_cells_sql(2)}) WHERE l_returnflag <> 'N' GROUP BY 1))
        SELECT coalesce(b.l_returnflag, c.l_returnflag) AS l_returnflag, round(c.precision - b.precision, 9) AS precision_delta, round(c.recall - b.recall, 9) AS recall_delta, round(c.f1 - b.f1, 9) AS f1_delta FROM b FULL JOIN c ON b.l_returnflag = c.l_returnflag""",
    "judged_round": f"""WITH c AS ({_cells_sql(3)}), j AS (SELECT l_returnflag, tp, fp, fn, fp + fn = 0 AS exact, fp + fn = 0 OR l_orderkey % 3 <> 0 AS judged, CASE WHEN fp + fn > 0 AND l_orderkey % 3 <> 0 THEN least(fp, fn, 1) ELSE 0 END AS fixed, CASE WHEN fp + fn > 0 AND l_orderkey % 6 IN (2, 4) THEN 1 ELSE 0 END AS unsure FROM c),
        s AS (SELECT l_returnflag, coalesce(sum(tp + fixed) FILTER (judged), 0)::BIGINT AS tp, coalesce(sum(fp - fixed) FILTER (judged), 0)::BIGINT AS fp, coalesce(sum(fn - fixed) FILTER (judged), 0)::BIGINT AS fn, sum(unsure)::BIGINT AS uncertain, count(*) FILTER (judged) AS judged, count(*) FILTER (NOT judged) AS unjudged FROM j GROUP BY 1)
        SELECT *, {_PRF} FROM s""",
    "claim_account": f"""WITH i AS (SELECT l_orderkey, l_linenumber, {_CODE}[l_partkey % 7 + 1] AS code FROM lineitem WHERE l_partkey % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, {_CODE}[l_suppkey % 7 + 1] FROM lineitem WHERE l_partkey % 4 = 0),
        u AS (SELECT l_orderkey, l_linenumber, code FROM i WHERE code NOT IN ('other', 'late') GROUP BY ALL),
        k AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) FILTER (l_tax = 0) AS policy, bool_or(l_quantity > 25) AS linked FROM lineitem GROUP BY ALL),
        s AS (SELECT l_orderkey, l_linenumber, policy, CASE WHEN policy IS NOT NULL THEN 'excluded' WHEN linked THEN 'supported' WHEN EXISTS (SELECT 1 FROM u WHERE u.l_orderkey = k.l_orderkey AND u.l_linenumber = k.l_linenumber) THEN 'not_completed' ELSE 'unsupported' END AS state FROM k)
        SELECT 'total' AS kind, 'claims' AS name, count(*) AS n FROM s UNION ALL SELECT 'total', 'eligible', count(*) FROM s WHERE state <> 'excluded' UNION ALL SELECT 'state', state, count(*) FROM s GROUP BY state
        UNION ALL SELECT 'policy', policy, count(*) FROM s WHERE state = 'excluded' GROUP BY 2 UNION ALL SELECT 'reason', code, count(*) FROM s JOIN u USING (l_orderkey, l_linenumber) WHERE state = 'not_completed' GROUP BY 2""",
    "duplicate_components": """WITH RECURSIVE o AS (SELECT l_partkey AS place, l_orderkey * 8 + l_linenumber AS id, l_linenumber AS crop, l_returnflag || l_linestatus AS t, l_quantity::BIGINT * 2 AS x, round(l_discount * 100)::BIGINT * 3 AS y FROM lineitem),
        p AS (SELECT a.id AS a, b.id AS b, 24 - abs(a.x - b.x) AS w, 15 - abs(a.y - b.y) AS h FROM o a JOIN o b ON a.place = b.place AND a.t = b.t AND a.id < b.id AND a.crop <> b.crop AND abs(a.crop - b.crop) * 10 < 25),
        e AS (SELECT a, b FROM p WHERE w > 0 AND h > 0 AND 2 * w * h >= 720 - w * h), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(a, b) AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
        l AS (SELECT a AS id, min(b) AS first, count(DISTINCT b) AS members FROM r GROUP BY 1)
        SELECT id, first, members, CASE WHEN members > 2 THEN 'potential' WHEN id = first THEN 'kept' ELSE 'dropped' END AS mark FROM l""",
}
