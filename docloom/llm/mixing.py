"""Mixing sources to target weights by the cube method.

Every document of a source is wanted target / source_size times: its whole part is taken outright, its fraction is an
inclusion probability. The flight phase moves the probabilities of three documents at a time along the null space of
the constraints (documents, words) until one of them is 0 or 1, so both totals stay as they are. Blocks of a source fly
at the same time on different executors; the two or so documents that each leaves open fly again together, until one
block a source is left. There a dozen documents over all sizes do not fly but are landed with the last open ones: of all
ways to settle them, the one that keeps both totals best is taken.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 1024
LANDING = 12
SEED = 20240613
_EPS = 1e-9


def fly(size: list[int], prob: list[float], rng: random.Random, aside: frozenset[int] = frozenset()) -> list[int]:
    """Flight phase in place, but for those aside, long documents first; returns the indexes it leaves open, two at most."""
    todo = sorted((i for i, p in enumerate(prob) if _EPS < p < 1 - _EPS and i not in aside), key=lambda i: (size[i], -i))
    held: list[int] = []
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) < 3:
            return held
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - prob[i]) / v if v > 0 else prob[i] / -v for i, v in zip(held, u) if v)
        down = min(prob[i] / v if v > 0 else (1 - prob[i]) / -v for i, v in zip(held, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(held, u):
            p = prob[i] + step * v
            prob[i] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
        held = [i for i in held if 0 < prob[i] < 1]


def for_landing(size: list[int], prob: list[float], n: int = LANDING) -> frozenset[int]:
    """Up to n open documents, evenly over the order of sizes."""
    by_size = sorted((i for i, p in enumerate(prob) if _EPS < p < 1 - _EPS), key=lambda i: (size[i], i))
    return frozenset(by_size[len(by_size) * k // n] for k in range(n)) if by_size else frozenset()


def land(size: list[int], prob: list[float], held: list[int]) -> None:
    """Landing in place: of all ways to settle the open documents the one that changes the words least, then the documents."""
    held = sorted(held)
    if not held:
        return
    s, p = np.array([size[i] for i in held], float), np.array([prob[i] for i in held])
    ways = (np.arange(1 << len(held))[:, None] >> np.arange(len(held))) & 1
    best = ways[np.lexsort((abs(ways.sum(1) - p.sum()), np.round(abs(ways @ s - s @ p), 6)))[0]]
    for i, v in zip(held, best):
        prob[i] = float(v)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, docs, target) of sizes (source, size). Sources by code point, null last, take the weights
    in turn; no target is above max_repeat times its source's size, and what is above is shared by weight again."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = materialize(per.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    # places over all sources: before this partition (one row each) and within it
    before = per.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = materialize(per.join(F.broadcast(before), "part").withColumn("place", place).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(max_repeat)).drop("part", "before", "place"))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    left, share = float(total), per.agg(F.sum("weight")).first()[0] or 1.0
    while True:  # each round caps at least one more source; two numbers come back
        above = F.col("weight") * F.lit(left / share if share else 0.0) > F.col("most")
        capped, open_share = per.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if open_share == share:
            break
        left, share = total - capped, open_share
        if not share:
            break
    level = F.col("weight") * F.lit(left) / F.lit(share) if share else F.col("most")
    return per.select("source", "source_size", "docs", F.least("most", level).cast("double").alias("target"))


def _flight(seed: int, last: bool):
    def run(key, t):
        t = t.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("nth", "ascending")])
        size, prob = t["size"].to_pylist(), t["prob"].to_pylist()
        rng = random.Random(f"{seed}|{key[0].as_py()!r}|{key[1].as_py()}|{key[2].as_py()}")
        aside = for_landing(size, prob) if last else frozenset()
        held = fly(size, prob, rng, aside)
        if last:
            land(size, prob, [*held, *aside])
        return t.set_column(t.schema.get_field_index("prob"), "prob", pa.array(prob, pa.float64()))

    return run


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, size (words), source_size, target (of its source), taken (words, repeats counted).

    A null text has size 0; documents of size 0 and sources of size 0 take nothing; a null source is a source of its
    own, last in order; a null doc_id and repeated rows are documents like any other; texts of any length count whole.
    Equal input gives equal output, whatever its partitions: ties are settled by id, size and, among equal rows, a
    number. An empty table gives an empty result; other columns are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))
    # equal rows are numbered by counting them, so they are dealt to all blocks and never gathered
    equal = materialize(given.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    sizes = equal.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    per = materialize(source_targets(sizes.select("source", "size"), weights, max_repeat))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(ratio + _EPS)).withColumn("prob", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    a, b = sizes.alias("a"), per.alias("b")
    cur = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("doc_id", F.col("a.source").alias("source"), "size", "nth", "source_size", "target", "whole", F.when(F.col("size") > 0, F.col("prob")).otherwise(0.0).alias("prob"), F.ceil(F.col("docs") / block).alias("blocks"))
    schema = "doc_id long, source string, size long, nth long, source_size long, target double, whole long, prob double, blocks long, level int, block long"
    done, level = None, 0
    most = per.agg(F.max(F.ceil(F.col("docs") / block))).first()[0] or 1
    while True:
        last = most <= 1
        put = cur.withColumn("level", F.lit(level)).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(level)), F.greatest("blocks", F.lit(1))))
        flown = materialize(put.groupBy("source", "level", "block").applyInArrow(_flight(seed, last), schema))
        is_open = (F.col("prob") > 0) & (F.col("prob") < 1)
        settled = flown.where(~is_open)
        done = settled if done is None else done.union(settled)
        if last:
            break
        still = flown.where(is_open)
        left = still.groupBy("source").agg(F.ceil(F.count("*") / block).alias("blocks"))
        c, d = still.drop("blocks").alias("c"), left.alias("d")
        cur = c.join(d, F.col("c.source").eqNullSafe(F.col("d.source"))).select(*(f"c.{x}" for x in ("doc_id", "source", "size", "nth", "source_size", "target", "whole", "prob")), "d.blocks")
        most, level = left.agg(F.max("blocks")).first()[0] or 1, level + 1
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.round("prob").cast("long"))).alias("taken"), "source")


def keep_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, with size, target (of the source), taken (words) and times.

    A row without an id can't be traced and takes no part. Equal rows (id, source, size) get the takes of as many
    documents, each its own. Columns of docs with the names of the new ones are replaced. Takes and texts are joined
    by one plan at every size, a merge join, so texts cross one shuffle.
    """
    new = ["size", "target", "taken", "times"]
    named = docs.where(F.col(id_col).isNotNull())
    takes = mix(named, id_col, text_col, source_col, **options).where("taken > 0").select("doc_id", "source", "size", "target", "taken")
    takes = materialize(takes.groupBy("doc_id", "source", "size").agg(F.first("target").alias("target"), F.sort_array(F.collect_list("taken"), False).alias("all")))
    d = named.drop(*(c for c in named.columns if c in new)).withColumn("size", size_of(F.col(text_col)))
    others = [c for c in d.columns if c != "size"]
    more = not takes.where(F.size("all") > 1).isEmpty()
    if more:  # equal rows are numbered after they have met
        d = d.withColumn("taken", F.row_number().over(Window.partitionBy(id_col, source_col, "size").orderBy(F.xxhash64(*others))))
    a, b = d.alias("a"), takes.hint("merge").alias("b")
    joined = a.join(b, (F.col(f"a.{id_col}").cast("long") == F.col("b.doc_id")) & F.col(f"a.{source_col}").cast("string").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
    taken = F.get("b.all", F.col("a.taken") - 1) if more else F.get("b.all", F.lit(0))
    out = joined.select(*(F.col(f"a.{c}") for c in others), F.col("a.size").alias("size"), F.col("b.target").alias("target"), taken.alias("taken")).where("taken is not null")
    return out.withColumn("times", (F.col("taken") / F.col("size")).cast("int"))


def op6_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op6_cube": op6_cube}
ORACLES: dict[str, str] = {}
