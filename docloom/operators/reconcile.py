"""Merging, comparing and accounting for values read more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.sweeps import covering
from docloom.sources.tables import read_table as T
from docloom.sources.tables import tasks_for

#: Resamples, the part outside the interval, and the seed of a bootstrap. Fixed values.
DRAWS, TAIL, SEED = 1000, 0.05, 20260927


def revision_counts(old: DataFrame, new: DataFrame, ident: str, compared: list[str]) -> DataFrame:
    """One row: nodes added and removed, and for each compared column the nodes that changed it; both by id."""
    pack = lambda df, n: df.select(ident, F.struct(*compared).alias(n))
    both = pack(old, "o").join(pack(new, "n"), ident, "full")
    o, n = F.col("o"), F.col("n")
    changed = [F.count_if(o.isNotNull() & n.isNotNull() & ~o[c].eqNullSafe(n[c])).alias(f"changed_{c}") for c in compared]
    return both.agg(F.count_if(o.isNull()).alias("added"), F.count_if(n.isNull()).alias("removed"), *changed)


def schema_diff_counts(spark, sf):
    """Parts as schema nodes: some go, some come, some get a name, type or description (size)."""
    p, k = T(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size"), F.col("p_partkey")
    new = p.where(k % 10 != 3).select(k, F.when(k % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), F.when(k % 11 == 0, "TEXT").otherwise(F.col("p_type")).alias("p_type"), F.when(k % 13 == 0, None).otherwise(F.col("p_size")).alias("p_size"))
    return revision_counts(p.where(k % 9 != 0), new, "p_partkey", ["p_name", "p_type", "p_size"])


def paired_effects(df: DataFrame, unit: list[str], arm: str, value: str, control: str, treatment: str) -> DataFrame:
    """(unit, effect): the mean under treatment less that under control, for units that have both."""
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    both = df.where(F.col(arm).isin(control, treatment)).groupBy(*unit).agg(mean(control).alias("__c"), mean(treatment).alias("__t"))
    return both.where("__c is not null and __t is not null").select(*unit, (F.col("__t") - F.col("__c")).alias("effect"))


def paired_effects_of_users(spark, sf):
    out = paired_effects(T(spark, sf, "events"), ["user_id"], "event_type", "value", "view", "click")
    return out.withColumn("effect", F.round("effect", 6))


def poisson_weights(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each key is in each resample: Poisson counts seeded by the key, the same wherever the row is."""
    out = np.empty((len(keys), draws), dtype=np.int64)
    for i, k in enumerate(keys):
        out[i] = np.random.Generator(np.random.Philox(key=[seed, np.uint64(np.int64(k))])).poisson(1.0, draws)
    return out


def bootstrap_interval(df: DataFrame, by: str, key: str, value: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, n, mean, low, high): a percentile interval of the mean. Each task adds up its rows' part of every resample,
    so a row is sent once a group, task and resample, however many rows there are. Null values take no part."""
    schema = f"{by} string, draw int, w bigint, wx double, n bigint, x double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                weights = poisson_weights(part[key].to_numpy(), draws, seed)
                groups = part[by].where(part[by].notna(), None)
                for g in groups.unique():
                    at = (groups.isna() if g is None else groups == g).to_numpy()
                    x, w = part[value].to_numpy(dtype=float)[at], weights[at]
                    s = sums.setdefault(g, [np.zeros(draws, np.int64), np.zeros(draws), 0, 0.0])
                    s[0] += w.sum(0)
                    s[1] += x @ w
                    s[2] += len(x)
                    s[3] += x.sum()
        for g, (w, wx, n, x) in sums.items():
            rows = pd.DataFrame({by: [g] * draws, "draw": range(draws), "w": w, "wx": wx, "n": 0, "x": 0.0})
            rows.loc[0, ["n", "x"]] = [n, x]
            yield rows.astype({"n": "int64"})

    per = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(by, key, F.col(value).cast("double").alias(value)).mapInPandas(partial, schema)
    means = per.groupBy(by, "draw").agg((F.sum("wx") / F.nullif(F.sum("w"), F.lit(0))).alias("m"), F.sum("n").alias("n"), F.sum("x").alias("x"))
    ordered = F.sort_array(F.collect_list("m"))
    out = means.groupBy(by).agg(F.sum("n").alias("n"), F.sum("x").alias("x"), ordered.alias("ms"))
    place = lambda q: F.get("ms", F.floor(F.size("ms") * F.lit(q)).cast("int"))
    return out.select(by, "n", F.round(F.col("x") / F.col("n"), 9).alias("mean"), F.round(place(TAIL / 2), 9).alias("low"), F.round(place(1 - TAIL / 2), 9).alias("high"))


def paired_bootstrap(spark, sf):
    """Per language: quality less toxicity of labelled documents, and its interval."""
    la = T(spark, sf, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("d"))
    return bootstrap_interval(T(spark, sf, "documents").select("doc_id", "lang").join(la, "doc_id"), "lang", "doc_id", "d")


def worst_results(df: DataFrame, keys: list[str], result: str, rank: dict[str, int]) -> DataFrame:
    """The worst result of each key; results that are not ranked count as best."""
    r: Column = F.lit(0)
    for name, n in rank.items():
        r = F.when(F.col(result) == name, n).otherwise(r)
    return df.groupBy(*keys).agg(F.max_by(result, F.struct(r, F.col(result))).alias(result))


def document_fields(spark, sf):
    j = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return worst_results(j, ["o_custkey", "o_orderpriority"], "o_orderstatus", {"O": 1, "P": 2, "F": 3})


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, before, after, change) of every key of either side: added, dropped, changed or same."""
    both = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("__b")).join(after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("__a")), keys, "full")
    kind = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "dropped").when(~F.col("before").eqNullSafe(F.col("after")), "changed").otherwise("same")
    return both.select(*keys, "before", "after", kind.alias("change"))


def link_changes(spark, sf):
    """Links (order line to supplier) that one run added, dropped or changed against another."""
    key = ["l_orderkey", "l_linenumber"]
    side = lambda df: df.groupBy(*key).agg(F.min("l_suppkey").alias("s"))
    li = T(spark, sf, "lineitem")
    new = li.where("l_returnflag <> 'N'").withColumn("l_suppkey", F.when(F.col("l_partkey") % 5 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")))
    return changes(side(li.where("l_returnflag <> 'A'")), side(new), key, "s").groupBy("change").agg(F.count("*").alias("n"))


def reply_variation(spark, sf):
    """Requests (user and hour) asked more than once, and how their replies differ."""
    ev = T(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "event_type").agg(F.count("*").alias("n"))
    out = ev.groupBy("user_id", F.unix_micros("h").alias("hour_us")).agg(F.sum("n").alias("calls"), F.count("*").alias("replies"), F.max("n").alias("agreeing"))
    return out.where("calls > 1").withColumn("varies", F.col("replies") > 1)


def dense_positions(spark, sf):
    """Kept items of a list (lines not returned) numbered anew from 0, ties sharing a number."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return T(spark, sf, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey", (F.dense_rank().over(w) - 1).cast("bigint").alias("position"))


def merged_observations(df: DataFrame, keys: list[str], window: str, tasks: int | None = None) -> DataFrame:
    """Observations with the same keys: one, if each window saw it once and more than one did; else kept as they are and
    ambiguous, if there is more than one. tasks: how many the keys are dealt to (`tasks_for`), for keys with few rows each."""
    df = df.select(*keys, window)
    out = (df.repartition(tasks, *keys) if tasks else df).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(window).alias("windows"))
    one = (F.col("n") > 1) & (F.col("n") == F.col("windows"))
    return out.select(*keys, F.when(one, 1).otherwise(F.col("n")).cast("bigint").alias("kept"), ((F.col("n") > 1) & ~one).alias("ambiguous"))


def observations_of_parts(spark, sf):
    li = T(spark, sf, "lineitem")
    return merged_observations(li, ["l_partkey", "l_suppkey"], "l_linenumber", tasks_for(li))


def first_support(spark, sf):
    """The first event of each user and type stands for it."""
    ev = T(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return ev


def identities(items: DataFrame, fields: list[str], label: str, place: str, support: str) -> tuple[DataFrame, DataFrame]:
    """(records, issues): items with the same identity are one record, its first item standing for it, with the support
    (array) of all in order of first appearance.

    The identity is all its fields, in any case and with any blanks. An item that lacks some is one only with items that
    have the same fields, label and support, so nothing is erased by what isn't known, and an issue (place, label,
    missing). Null supports add nothing.
    """
    form = lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(c.cast("string")), r"\s+", " ")), F.lit(""))
    lacks = F.array_compact(F.array(*(F.when(form(F.col(f)).isNull(), F.lit(f)) for f in fields)))
    own = F.when(F.size(lacks) > 0, F.struct(form(F.col(label)).alias("label"), F.array_sort(F.array_distinct(F.col(support))).alias("support")))
    key = F.to_json(F.struct(F.struct(*(form(F.col(f)).alias(f) for f in fields)).alias("identity"), own.alias("own")))
    keyed = items.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min_by(F.struct(place, label, *fields), place).alias("f"), F.count("*").alias("items"))
    seen = keyed.select("__key", place, F.posexplode(support).alias("i", "s")).groupBy("__key", "s").agg(F.min(F.struct(place, "i")).alias("at"))
    joined = seen.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias(support))
    nothing = F.array().cast(items.schema[support].dataType)
    records = first.join(joined, "__key", "left").select("f.*", "items", F.coalesce(support, nothing).alias(support))
    issues = items.where(F.size(lacks) > 0).select(place, label, F.array_join(lacks, ",").alias("missing"))
    return records, issues


def reconciled_identities(spark, sf):
    """Parts with one name and brand, and the suppliers that any of them has."""
    sup = T(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("suppliers"))
    records, _ = identities(T(spark, sf, "part").join(sup, "p_partkey"), ["p_name", "p_brand"], "p_type", "p_partkey", "suppliers")
    return records.select("p_partkey", F.col("items").alias("parts"), F.array_join(F.transform("suppliers", lambda x: x.cast("string")), ",").alias("suppliers"))


def items_joined_once(df: DataFrame, group: str, reading: str, item: str) -> DataFrame:
    """(group, item, place, readers): lists read several times. An item joins the first kept one that is equal and that its
    reading has not joined yet, else it is kept as new; so the k-th equal item of each reading meets the k-th of the
    others, and counts a reading are all that is shuffled."""
    counts = df.groupBy(group, item, reading).agg(F.count("*").alias("n"))
    return counts.select(group, item, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("place")).groupBy(group, item, "place").agg(F.count("*").alias("readers"))


def list_items_joined_once(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).alias("item"), (F.col("l_suppkey") % 3).alias("reading"))
    return items_joined_once(li, "l_orderkey", "reading", "item")


def orphans(spark, sf):
    """Lines whose order is missing or not live (fulfilled)."""
    live = T(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return T(spark, sf, "lineitem").join(live, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("children"))


def covering_cell(spark, sf):
    """Events (points) inside exactly one of their user's hours that begin with a purchase."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = T(spark, sf, "events").select("user_id", "event_id", "event_type", us.alias("s"))
    cells = ev.where("event_type = 'purchase'").withColumn("e", F.col("s") + 3_600_000_000)
    hits = covering(ev.where("event_type = 'click'").withColumn("e", F.col("s")), cells, "user_id", "event_id", "s", "e")
    return hits.select("user_id", F.col("span").alias("event_id"), "cell")


def project_phases(spark, sf):
    """Customers as projects: without orders ingest, with an urgent one validate, with a pending one extract, else chat."""
    per = T(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("u"), F.max((F.col("o_orderstatus") == "P").cast("int")).alias("p"))
    phase = F.when(F.col("u").isNull(), "ingest").when(F.col("u") == 1, "validate").when(F.col("p") == 1, "extract").otherwise("chat")
    return T(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", phase.alias("phase"))


def ingestion_feed(spark, sf):
    """Of uploads (events), those to show: running ones, successes of the last 15 minutes, and failures of 30 days that
    no later success of their user supersedes. Now is the newest event."""
    ev = T(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    done = ev.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("us").alias("last_success"))
    now = ev.agg(F.max("us").alias("now"))
    age = F.col("now") - F.col("us")
    later = F.coalesce(F.col("last_success") > F.col("us"), F.lit(False))
    minute = 60_000_000
    shown = (F.col("event_type") == "signup") | ((F.col("event_type") == "purchase") & (age <= 15 * minute)) | ((F.col("event_type") == "error") & (age <= 30 * 24 * 60 * minute) & ~later)
    # now is one row
    return ev.join(done, "user_id", "left").crossJoin(F.broadcast(now)).where(shown).select("event_id", "event_type")


QUERIES = {f.__name__: f for f in (schema_diff_counts, paired_effects_of_users, paired_bootstrap, document_fields, link_changes, reply_variation, dense_positions, observations_of_parts, first_support, reconciled_identities, list_items_joined_once, orphans, covering_cell, project_phases, ingestion_feed)}
ORACLES = {
    "schema_diff_counts": """WITH o AS (SELECT p_partkey, p_name, p_type, p_size FROM part WHERE p_partkey % 9 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 11 = 0 THEN 'TEXT' ELSE p_type END AS p_type, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS p_size FROM part WHERE p_partkey % 10 <> 3)
        SELECT count(*) FILTER (o.p_partkey IS NULL) AS added, count(*) FILTER (n.p_partkey IS NULL) AS removed, """
    + ", ".join(f"count(*) FILTER (o.p_partkey IS NOT NULL AND n.p_partkey IS NOT NULL AND o.{c} IS DISTINCT FROM n.{c}) AS changed_{c}" for c in ("p_name", "p_type", "p_size")) + " FROM o FULL JOIN n ON o.p_partkey = n.p_partkey",
    "paired_effects_of_users": "SELECT user_id, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 6) AS effect FROM events GROUP BY 1 HAVING count(value) FILTER (event_type = 'click') > 0 AND count(value) FILTER (event_type = 'view') > 0",
    "document_fields": "SELECT o_custkey, o_orderpriority, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'F' WHEN 2 THEN 'P' ELSE 'O' END AS o_orderstatus FROM orders GROUP BY 1, 2",
    "link_changes": """WITH a AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS a FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, min(CASE WHEN l_partkey % 5 = 0 THEN l_suppkey + 1 ELSE l_suppkey END) AS b FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
        SELECT CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'dropped' WHEN a <> b THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1""",
    "reply_variation": "WITH e AS (SELECT user_id, epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT user_id, hour_us, sum(n)::BIGINT AS calls, count(*) AS replies, max(n) AS agreeing, count(*) > 1 AS varies FROM e GROUP BY 1, 2 HAVING sum(n) > 1",
    "dense_positions": "SELECT l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS position FROM lineitem WHERE l_returnflag <> 'R'",
    "observations_of_parts": "SELECT l_partkey, l_suppkey, CASE WHEN count(*) > 1 AND count(*) = count(DISTINCT l_linenumber) THEN 1 ELSE count(*) END AS kept, count(*) > count(DISTINCT l_linenumber) AS ambiguous FROM lineitem GROUP BY 1, 2",
    "first_support": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "reconciled_identities": """WITH j AS (SELECT DISTINCT p_name, p_brand, p_partkey, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey), f AS (SELECT p_name, p_brand, l_suppkey, min(p_partkey) AS first FROM j GROUP BY ALL),
        k AS (SELECT p_name, p_brand, min(p_partkey) AS p_partkey, count(DISTINCT p_partkey) AS parts FROM j GROUP BY ALL)
        SELECT p_partkey, parts, string_agg(l_suppkey, ',' ORDER BY first, l_suppkey) AS suppliers FROM k JOIN f USING (p_name, p_brand) GROUP BY ALL""",
    "list_items_joined_once": """WITH c AS (SELECT l_orderkey, l_partkey % 4 AS item, l_suppkey % 3 AS reading, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT l_orderkey, item, unnest(range(n)) AS place FROM c) SELECT l_orderkey, item, place, count(*) AS readers FROM p GROUP BY 1, 2, 3""",
    "orphans": "SELECT l_orderkey, count(*) AS children FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1",
    "covering_cell": "WITH e AS (SELECT *, epoch_us(ts) AS us FROM events) SELECT c.user_id, c.event_id, min(p.event_id) AS cell FROM e c JOIN e p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.us <= c.us AND c.us < p.us + 3600000000 GROUP BY 1, 2 HAVING count(*) = 1",
    "project_phases": "WITH p AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS u, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN u IS NULL THEN 'ingest' WHEN u THEN 'validate' WHEN p THEN 'extract' ELSE 'chat' END AS phase FROM customer LEFT JOIN p ON o_custkey = c_custkey",
    "ingestion_feed": """WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), s AS (SELECT user_id, max(us) AS last FROM e WHERE event_type = 'purchase' GROUP BY 1), n AS (SELECT max(us) AS now FROM e)
        SELECT event_id, event_type FROM e LEFT JOIN s USING (user_id), n WHERE event_type = 'signup' OR (event_type = 'purchase' AND now - us <= 900000000) OR (event_type = 'error' AND now - us <= 2592000000000 AND coalesce(last <= us, true))""",
}
