"""Entries put together from what a reader said about each window of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import read_table as T


def assemble(windows: DataFrame, places: DataFrame, doc: str, window: str) -> DataFrame:
    """(doc, start, stop, kind, label, end): the regions of each document, in order.

    windows: (doc, window, start, stop, ok, begins, ends, withheld): whether it could be read, whether it begins and
    ends inside an entry (null: not said), and whether unread text follows the document. places: (doc, window, at, kind,
    label), at places of their own, kind record, other or unresolved.

    Text before a window's first place joins the entry open there if both windows say that it goes on. Else it is
    `other` where nothing is said to go on at either side, and otherwise unresolved, as is a window that was not read.
    end tells how a record ends: validated, unresolved or source_end; null for other regions. Places of a window that
    was not read are left out. A document's windows are one window partition.
    """
    w = Window.partitionBy(doc).orderBy(window)
    said = windows.select(
        doc, window, "start", "ok", "begins", (F.lag("ok").over(w) & ~F.lag("ends").over(w)).alias("clean"), F.lag("ok").over(w).isNull().alias("first"),
        (F.col("ok") & F.lag("ok").over(w) & F.lag("ends").over(w) & F.col("begins")).alias("joinable"),
    ).withColumns({"clean": F.coalesce("clean", F.lit(False)), "joinable": F.coalesce("joinable", F.lit(False))})
    known = places.join(said.where("ok").select(doc, window, "start", "begins", "clean"), [doc, window])
    at_start = F.col("at") == F.col("start")
    good = lambda c: F.when(c, "validated").otherwise("unresolved")
    closes = F.when(at_start, good(F.col("clean") & F.coalesce(~F.col("begins"), F.lit(False)))).otherwise(good(F.col("kind") != "unresolved"))
    marks = known.select(doc, F.col("at").alias("start"), "kind", "label", F.lit(False).alias("joinable"), closes.alias("closes"))
    led = known.where(at_start).select(doc, window).distinct()
    quiet = F.coalesce(~F.col("begins"), F.lit(False)) & (F.col("first") | F.col("clean"))
    heads = said.join(led, [doc, window], "left_anti").select(doc, "start", F.when(F.col("ok") & quiet, "other").otherwise("unresolved").alias("kind"), F.lit(None).cast("string").alias("label"), "joinable", good(F.col("ok") & F.col("clean")).alias("closes"))
    last = F.when(F.col("last.ends"), F.when(F.col("last.withheld"), "unresolved").otherwise("source_end")).otherwise(good(F.coalesce(~F.col("last.ends"), F.lit(False))))
    ending = windows.groupBy(doc).agg(F.max_by(F.struct("stop", "ends", "withheld"), window).alias("last"))
    at = Window.partitionBy(doc).orderBy("start")
    opened = F.last(F.when(~F.col("joinable"), F.col("kind") == "record"), True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    made = marks.union(heads).withColumn("opened", F.coalesce(opened, F.lit(False))).where("not (joinable and opened)")
    told = made.withColumn("stop", F.lead("start").over(at)).withColumn("next", F.lead("closes").over(at)).join(ending, doc)
    end = F.when(F.col("kind") == "record", F.coalesce("next", last))
    return told.select(doc, "start", F.coalesce("stop", "last.stop").alias("stop"), "kind", "label", end.alias("end"))


def discovered_regions(spark, sf):
    """Each four events of a user stand for a window: the first for what was said of it, the others for places in it."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ev = T(spark, sf, "events").where("user_id is not null").select("user_id", "event_id", "event_type", i.cast("bigint").alias("i")).selectExpr("*", "floor((i - 1) / 4) AS k")
    said = lambda n: f"CASE floor(event_id / {n}) % 3 WHEN 0 THEN true WHEN 1 THEN false END"
    windows = ev.where("i % 4 = 1").selectExpr("user_id", "k", "i * 10 AS start", "i * 10 + 40 AS stop", "event_id % 11 <> 0 AS ok", f"{said(1)} AS begins", f"{said(3)} AS ends", "event_id % 2 = 0 AS withheld")
    kind = "CASE event_type WHEN 'click' THEN 'record' WHEN 'view' THEN 'other' ELSE 'unresolved' END AS kind"
    places = ev.where("i % 4 <> 1").selectExpr("user_id", "k", "if(i % 4 = 2 and event_id % 2 = 0, i * 10 - 10, i * 10) AS at", kind, "concat('e', event_id) AS label")
    return assemble(windows, places, "user_id", "k")


QUERIES = {"discovered_regions": discovered_regions}
ORACLES = {
    "discovered_regions": """WITH e AS (SELECT user_id, event_id, event_type, i, (i - 1) // 4 AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL)),
        w AS (SELECT user_id, k, i * 10 AS start, i * 10 + 40 AS stop, event_id % 11 <> 0 AS ok, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b, CASE (event_id // 3) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS e, event_id % 2 = 0 AS withheld FROM e WHERE i % 4 = 1),
        s AS (SELECT w.*, p.k IS NULL AS first, coalesce(p.ok AND NOT p.e, false) AS clean, coalesce(w.ok AND p.ok AND p.e AND w.b, false) AS joinable FROM w LEFT JOIN w p ON p.user_id = w.user_id AND p.k = w.k - 1),
        p AS (SELECT e.user_id, e.k, CASE WHEN i % 4 = 2 AND event_id % 2 = 0 THEN i * 10 - 10 ELSE i * 10 END AS pos, CASE event_type WHEN 'click' THEN 'record' WHEN 'view' THEN 'other' ELSE 'unresolved' END AS kind, concat('e', event_id) AS label FROM e WHERE i % 4 <> 1),
        r AS (SELECT p.user_id, pos AS start, kind, label, false AS joinable, CASE WHEN pos = s.start THEN clean AND coalesce(NOT b, false) ELSE kind <> 'unresolved' END AS fine FROM p JOIN s ON p.user_id = s.user_id AND p.k = s.k AND s.ok
            UNION ALL SELECT user_id, start, CASE WHEN ok AND b = false AND (first OR clean) THEN 'other' ELSE 'unresolved' END, NULL, joinable, ok AND clean FROM s WHERE NOT (ok AND EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id AND p.k = s.k AND p.pos = s.start))),
        o AS (SELECT r.*, (SELECT q.kind FROM r q WHERE q.user_id = r.user_id AND q.start < r.start AND NOT q.joinable ORDER BY q.start DESC LIMIT 1) AS before FROM r),
        m AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt, lead(fine) OVER (PARTITION BY user_id ORDER BY start) AS nfine FROM o WHERE NOT (joinable AND coalesce(before = 'record', false))),
        l AS (SELECT DISTINCT ON (user_id) user_id, stop, e, withheld FROM w ORDER BY user_id, k DESC)
        SELECT m.user_id, m.start, coalesce(nxt, l.stop) AS stop, kind, label, CASE WHEN kind <> 'record' THEN NULL WHEN nfine IS NOT NULL THEN CASE WHEN nfine THEN 'validated' ELSE 'unresolved' END WHEN l.e AND NOT l.withheld THEN 'source_end' WHEN l.e IS false THEN 'validated' ELSE 'unresolved' END AS "end" FROM m JOIN l ON m.user_id = l.user_id""",
}
