"""Joins of intervals by sorted sweeps.

Rows are sorted by key and start and dealt to tasks in ranges; a task goes through its rows with the set of those still
open. An interval that reaches into the ranges of later tasks is carried there, once each, and there it meets at least
the row that begins the range, so nothing is copied that gives no pair. No key is compared as a whole, and a key with a third
of all rows is shared by as many tasks as it needs.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.pandas.types import to_arrow_type

from docloom.sources.tables import read_table as T
from docloom.sources.tables import tasks_for
from docloom.sources.written import materialize

_BATCH = 50_000


def _ranged(df: DataFrame, *order: str, tasks: int | None = None) -> DataFrame:
    """The rows with the number of their range (`block`), written: ranges follow each other in the order."""
    parts = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id()))


def _pairs(batches, two_sides: bool, kinds):
    """Sweeps rows (key, start, end, side, id, carried) sorted by key, start, side and id.

    Open rows are places in `ids`, so a row meets all of them at once; an open set is gone through again only when one of its
    intervals has ended.
    """
    key, open_, ends, places = None, [[], []], [None, None], [None, None]
    keys, ids, out, waiting = [], [], ([], [], []), 0

    def batch():
        cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        of = [pa.array(x, t) for x, t in zip((keys, ids, ids), kinds)]
        b = pa.RecordBatch.from_arrays([x.take(pa.array(c)) for x, c in zip(of, cols)], names=["key", "a", "b"])
        for c in out:
            c.clear()
        # the key and the open rows are still needed
        keys[:-1] = []
        held = [ids[j] for s in open_ for _, j in s]
        at = iter(range(len(held)))
        open_[:] = [[(end, next(at)) for end, _ in s] for s in open_]
        places[:] = [None, None]
        ids[:] = held
        return b

    for rows in batches:
        for k, start, end, side, i, carried in zip(*(rows.column(n).to_pylist() for n in range(6))):
            if k != key:
                key, open_[:], ends, places[:] = k, [[], []], [None, None], [None, None]
                keys.append(k)
                waiting += 1
            for n, s in enumerate(open_):
                if s and ends[n] <= start:
                    open_[n] = s = [x for x in s if x[0] > start]
                    ends[n], places[n] = min((x[0] for x in s), default=None), None
            n = 1 - side if two_sides else 0
            if not carried and open_[n]:
                if places[n] is None:
                    places[n] = np.fromiter((j for _, j in open_[n]), np.int64, len(open_[n]))
                met, own = places[n], np.full(len(open_[n]), len(ids))
                ids.append(i)
                if two_sides:
                    a, b = (own, met) if side == 0 else (met, own)
                else:
                    less = np.fromiter((ids[j] < i for _, j in open_[n]), bool, len(met))
                    a, b = np.where(less, met, own), np.where(less, own, met)
                for c, x in zip(out, (np.full(len(met), len(keys) - 1), a, b)):
                    c.append(x)
                waiting += len(met) + 1
            if end > start:
                n = side if two_sides else 0
                ends[n] = min(ends[n], end) if open_[n] else end
                open_[n].append((end, len(ids)))
                places[n] = None
                ids.append(i)
                waiting += 1
            if waiting >= _BATCH:
                yield batch()
                waiting = 0
    yield batch()


def overlap_pairs(left: DataFrame, right: DataFrame | None, key: str, ident: str, start: str, end: str, tasks: int | None = None) -> DataFrame:
    """(key, a, b): rows of one key whose half-open intervals overlap: left ones (a) with right ones (b), or, without
    right, rows of left with each other, a < b. A point (start = end) is in an interval that holds it or starts there, as
    a right row; intervals with a null key or end take no part. Starts and ends are of any one sortable type. tasks: how
    many ranges the rows are dealt to (`tasks_for`; few rows each where a row meets very many), else the session's number."""
    side = lambda df, n: df.select(F.col(key).alias("key"), F.col(start).alias("start"), F.col(end).alias("end"), F.lit(n).alias("side"), F.col(ident).alias("id"))
    rows = (side(left, 0) if right is None else side(left, 0).union(side(right, 1))).where("key IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND start <= end")
    ranged = _ranged(rows, "key", "start", "side", "id", tasks=tasks)
    # where each range begins: a row a task, not a row a key
    bounds = ranged.groupBy("block").agg(F.min(F.struct("key", "start")).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "block"))).alias("bounds"))
    reach = F.array_max(F.transform(F.filter("bounds", lambda b: b["at"] < F.struct(F.col("key"), F.col("end"))), lambda b: b["block"]))
    copies = ranged.join(F.broadcast(bounds)).withColumn("to", reach).where(F.col("to") > F.col("block"))
    copies = copies.select("key", "start", "end", "side", "id", F.explode(F.sequence(F.col("block") + 1, "to")).alias("block"), F.lit(True).alias("carried"))
    dealt = ranged.select("key", "start", "end", "side", "id", "block", F.lit(False).alias("carried")).union(copies)
    # a range a task, as ranges of few rows may give most pairs
    dealt = dealt.repartitionById(tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "key", "start", "side", "id")
    kind = rows.schema
    schema = K.StructType([K.StructField(n, kind[c].dataType) for n, c in (("key", "key"), ("a", "id"), ("b", "id"))])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    two = right is not None
    swept = dealt.select("key", "start", "end", "side", "id", "carried", "block").mapInArrow(lambda batches: _by_block(batches, two, kinds), schema)
    return swept.withColumnRenamed("key", key)


def _by_block(batches, two_sides: bool, kinds):
    """Sweeps each range by itself: a task may get several."""
    def parts():
        for b in batches:
            block = b.column(6).to_pylist()
            at = 0
            for n, run in groupby(block):
                size = len(list(run))
                yield n, b.slice(at, size)
                at += size

    for _, run in groupby(parts(), key=lambda x: x[0]):
        yield from _pairs((b for _, b in run), two_sides, kinds)


def covered_lengths(rows: DataFrame, cover: DataFrame, key: str, ident: str, start: str, end: str) -> DataFrame:
    """(ident, covered): of each row's half-open interval, the summed lengths that it shares with the cover's intervals of
    its key, counted as often as they cover it. Integer places; rows without a key in the cover have 0.

    The shared length is C(end) - C(start), where C(x) adds up what the cover has before x: x times the number of
    intervals begun less ended, less the sum of their places. So running sums over the sorted ends do, and no row meets
    another. A key's ends may lie in many ranges; each range adds the totals of the key's ranges before it.
    """
    edge = lambda df, c, n: df.select(F.col(key).alias("key"), F.col(c).cast("long").alias("x"), F.lit(n).alias("n"), F.lit(None).cast(rows.schema[ident].dataType).alias("id"), F.lit(0).alias("sign"))
    ask = lambda c, sign: rows.select(F.col(key).alias("key"), F.col(c).cast("long").alias("x"), F.lit(0).alias("n"), F.col(ident).alias("id"), F.lit(sign).alias("sign"))
    valid = cover.where(F.col(start) < F.col(end))
    ends = edge(valid, start, 1).union(edge(valid, end, -1)).union(ask(start, -1)).union(ask(end, 1)).where("key IS NOT NULL AND x IS NOT NULL")
    ranged = _ranged(ends, "key", "x")
    place = (F.col("n") * F.col("x")).cast("decimal(38,0)")
    totals = ranged.groupBy("key", "block").agg(F.sum("n").alias("n"), F.sum(place).alias("s"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    w = Window.partitionBy("key", "block").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    at = ranged.withColumns({"n1": F.sum("n").over(w), "s1": F.sum(place).over(w)}).where("sign <> 0").join(carried, ["key", "block"])
    c = F.col("x") * (F.col("n0") + F.col("n1")) - (F.col("s0") + F.col("s1"))
    return at.groupBy("id").agg(F.sum(F.col("sign") * c).cast("long").alias("covered")).withColumnRenamed("id", ident)


def covering(spans: DataFrame, cells: DataFrame, key: str, ident: str, start: str, end: str) -> DataFrame:
    """(key, span, cell): spans that lie wholly in exactly one of their key's cells, and that cell. Spans that no cell or
    several hold have no row; a point is in a cell from its start on."""
    of = lambda df, n: df.select(key, F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.col(ident).alias("id")).alias(n), F.col(start).alias("s"), F.col(end).alias("e"))
    keyed = lambda df, n: of(df, n).withColumn("id", F.to_json(n)).select(key, "id", "s", "e")
    kind = of(cells, "x").schema["x"].dataType.simpleString()
    met = overlap_pairs(keyed(cells, "c"), keyed(spans, "p"), key, "id", "s", "e").select(key, F.from_json("a", kind).alias("c"), F.from_json("b", kind).alias("p"))
    held = met.where("c.start <= p.start AND p.end <= c.end").groupBy(key, F.col("p.id").alias("span"), F.col("p.start").alias("start"), F.col("p.end").alias("end")).agg(F.count("*").alias("n"), F.min("c.id").alias("cell"))
    return held.where("n = 1").select(key, "span", "cell")


def path_key(steps):
    """A path of steps (array of text) as a text that sorts right behind its ancestors' and starts with them: each step
    ends with the lowest character, which steps have not."""
    return F.array_join(F.transform(steps, lambda x: F.concat(x, F.lit("\u0001"))), "")


def ancestors(links: DataFrame, items: DataFrame, group: str, ident: str, path: str, tasks: int | None = None) -> DataFrame:
    """(group, a, b): items (a) whose path is that of a link (b) or above it, within a group. Paths are arrays of steps.

    A path's descendants lie in one interval of the sorted keys, so links meet the items above them in a sweep whose
    open set is one chain of ancestors; no path is listed with all its prefixes. An empty path is above all; null paths take no part.
    """
    keyed = lambda df, end: df.where(F.col(path).isNotNull()).select(group, ident, path_key(F.col(path)).alias("start")).withColumn("end", end)
    return overlap_pairs(keyed(items, F.concat("start", F.lit("\U0010ffff"))), keyed(links, F.col("start")), group, ident, "start", "end", tasks)


def _spans(spark, sf, seconds: int) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return T(spark, sf, "events").select("user_id", "event_id", "event_type", us.alias("s"), (us + F.floor(F.col("value") * seconds * 1_000_000).cast("bigint") + 1).alias("e"))


def covered_clicks(spark, sf):
    """Of each click's span, the microseconds covered by the spans of the user's views."""
    ev = _spans(spark, sf, 3600)
    return covered_lengths(ev.where("event_type = 'click'"), ev.where("event_type = 'view'"), "user_id", "event_id", "s", "e")


def clicks_during_errors(spark, sf):
    """Pairs of an error (a) and a click (b) of one user whose spans overlap."""
    ev = _spans(spark, sf, 600)
    return overlap_pairs(ev.where("event_type = 'error'"), ev.where("event_type = 'click'"), "user_id", "event_id", "s", "e")


def folders_above_pages(spark, sf):
    """Pages as folders of their host (their url's steps but for the last) and as links: the folders above each page."""
    steps = F.split(F.regexp_replace(F.regexp_extract("url", r"://[^/?#]*/?([^?#]*)", 1), "/$", ""), "/")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    table = T(spark, sf, "pages")
    pages = table.where("url IS NOT NULL").select(host.alias("host"), "page_id", steps.alias("path"))
    folders = pages.withColumn("path", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))
    return ancestors(pages, folders, "host", "page_id", "path", tasks_for(table, 1000))


QUERIES = {f.__name__: f for f in (covered_clicks, clicks_during_errors, folders_above_pages)}
_E = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + floor(value * {n} * 1000000)::BIGINT + 1 AS e FROM events)"
ORACLES = {
    "covered_clicks": "WITH " + _E.replace("{n}", "3600") + """ SELECT a.event_id, coalesce(sum(CASE WHEN b.s IS NOT NULL THEN least(a.e, b.e) - greatest(a.s, b.s) END), 0)::BIGINT AS covered FROM e a LEFT JOIN e b ON b.event_type = 'view' AND a.user_id = b.user_id AND a.s < b.e AND b.s < a.e
        WHERE a.event_type = 'click' AND a.user_id IS NOT NULL GROUP BY a.event_id""",
    "clicks_during_errors": "WITH " + _E.replace("{n}", "600") + " SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'error' AND b.event_type = 'click'",
    "folders_above_pages": """WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id, string_split(regexp_replace(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), '/$', ''), '/') AS path FROM pages WHERE url IS NOT NULL)
        SELECT b.host, a.page_id AS a, b.page_id AS b FROM p b JOIN p a ON a.host = b.host AND len(a.path) - 1 <= len(b.path) AND a.path[1:len(a.path) - 1] = b.path[1:len(a.path) - 1]""",
}
