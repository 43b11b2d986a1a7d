"""Joins that keep common keys where they lie, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.written import discard, materialize

#: A key with more rows than this, and than 1 / SHARE of all rows, is joined by sending its one row instead; there are at
#: most SHARE such keys, whatever the data.
HOT_ROWS, SHARE = 1000, 1000


def spread_join(big: DataFrame, small: DataFrame, key: str, rows: str, total: int, hot_rows: int | None = None) -> DataFrame:
    """big joined with small (one row a key, `rows` = how many rows of big the key has; total = all of them).

    Rows of common keys are joined where they lie, so no task gets all rows of a key; the others meet by a shuffle.
    The column `rows` is not returned.
    """
    limit = max(hot_rows or HOT_ROWS, total // SHARE)
    if total <= limit:
        return big.join(small.drop(rows), key)
    small = materialize(small)
    hot, cool = small.where(F.col(rows) > limit).drop(rows), small.where(F.col(rows) <= limit).drop(rows)
    if hot.isEmpty():
        return big.join(small.drop(rows), key)
    hot = F.broadcast(hot)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(cool, key))


#: A hub of the graph with more links than this is not left to one task; a whole graph of no more is.
HUB_LINKS = 50_000


def _least_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of links (src, dst) that all are in these batches."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(top, nodes), pa.int64())], names=["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (src, dst), both long: rows (node, component = smallest node).

    Alternates large-star and small-star steps, each a map-side combined minimum and a spread join, so a node of very
    many links is never gathered. Every round is written to the shared folder. A graph of HUB_LINKS links at most takes no
    rounds, but one task. No edges: no rows. Self loops and repeated links do no harm.
    """
    cur = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())

    def stats(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()

    seen = stats(cur)
    if seen[0] <= HUB_LINKS:
        return cur.coalesce(1).mapInArrow(_least_of_each, "node long, component long")
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.union(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"), F.count("*").alias("k"))
        large = spread_join(both.where("dst > src"), least, "src", "k", 2 * seen[0], HUB_LINKS).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        if seen[0] > HUB_LINKS:
            large = materialize(large)
        low = large.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("k"))
        small = spread_join(large, low, "src", "k", seen[0], HUB_LINKS)
        nxt = small.select("src", F.col("m").alias("dst")).union(small.select(F.col("dst").alias("src"), F.col("m").alias("dst"))).where("src <> dst").distinct()
        nxt = materialize(nxt)
        now = stats(nxt)
        discard(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = cur.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.union(cur.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
