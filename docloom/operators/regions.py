"""Regions of pages: recursive cuts, unions of what overlaps, and places for regions in a page's order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import components
from docloom.sources.tables import read_table as T
from docloom.sources.written import discard, materialize

#: A gap of more than this cuts; a box of at least this part of its region's width may bridge columns; labels of text. Fixed values.
MIN_GAP, SPAN = 6, 0.6
TEXT_LABELS = ("text", "list_item", "section_header")


def _runs(df: DataFrame, by: list[str], lo: str, hi: str, name: str) -> DataFrame:
    """Adds, along one axis, the number of a row's run (`name`, from 0; a gap of more than MIN_GAP ends one) and the cut
    before the run (`<name>_cut`, the gap's middle; null before the first)."""
    w = Window.partitionBy(*by).orderBy(lo, hi, "id")
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__cut", F.when(F.col(lo) - reach > MIN_GAP, (F.col(lo) + reach) / 2))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.count("__cut").over(upto), f"{name}_cut": F.last("__cut", True).over(upto)}).drop("__cut")


def _next_cut(by: list[str], run: str) -> Column:
    return F.min(f"{run}_cut").over(Window.partitionBy(*by).orderBy(run).rangeBetween(1, Window.unboundedFollowing))


def page_leaves(boxes: DataFrame, page: str, width: float, height: float) -> DataFrame:
    """boxes (page, id, x0, y0, x1, y1, label) with their leaf of the recursive cut: node (places on the way down, which
    sort in reading order), kind (page, column, band or figure) and the leaf's extent left, right, top, bottom.

    A region is cut at its blank columns; one without any, whose other boxes would have some but for wide ones, into bands
    around the wide ones; and so on until nothing cuts. Cuts lie in the middle of gaps. A leaf with a box that is no text
    is a figure. Null coordinates take no part. All open regions of all pages advance together, a few sweeps a level;
    a page's region is a window partition, sorted on disk if need be.
    """
    have = boxes.columns
    node = ["page", "node"]
    cur = boxes.withColumnRenamed(page, "page").where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    cur = cur.withColumns({"node": F.array().cast("array<bigint>"), "kind": F.lit("page"), "left": F.lit(float(0)), "right": F.lit(float(width)), "top": F.lit(float(0)), "bottom": F.lit(float(height))})
    keep = cur.columns
    done = None
    while True:
        whole = Window.partitionBy(*node)
        at = _runs(cur, node, "x0", "x1", "xr")
        at = at.withColumn("wide", F.col("x1") - F.col("x0") >= SPAN * (F.max("x1").over(whole) - F.min("x0").over(whole)))
        at = _runs(at, [*node, "wide"], "x0", "x1", "nr")
        at = _runs(at, node, "y0", "y1", "yr")
        at = at.withColumns({"columns": F.max("xr").over(whole) > 0, "bridged": F.max("wide").over(whole) & F.coalesce(F.max(F.when(~F.col("wide"), F.col("nr"))).over(whole) > 0, F.lit(False))})
        # neighbouring bands without a wide box are one
        at = at.withColumn("has_wide", F.max("wide").over(Window.partitionBy(*node, "yr")))
        order = Window.partitionBy(*node).orderBy("y0", "y1", "id")
        starts = (F.lag("yr").over(order) != F.col("yr")) & (F.col("has_wide") | F.lag("has_wide").over(order))
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        at = at.withColumns({"br_cut": F.last(F.when(starts, F.col("yr_cut")), True).over(upto), "br": F.count_if(F.coalesce(starts, F.lit(False))).over(upto)})
        at = at.withColumns({"bands": ~F.col("columns") & F.col("bridged") & (F.max("br").over(whole) > 0), "x_next": _next_cut(node, "xr"), "b_next": _next_cut(node, "br")})
        moved = materialize(at.select(
            "columns", "bands", *(c for c in have if c != page), "page",
            F.when(F.col("columns"), F.concat("node", F.array("xr"))).when(F.col("bands"), F.concat("node", F.array("br"))).otherwise(F.col("node")).alias("node"),
            F.when(F.col("columns"), "column").when(F.col("bands"), "band").otherwise(F.col("kind")).alias("kind"),
            F.when(F.col("columns"), F.coalesce("xr_cut", "left")).otherwise(F.col("left")).alias("left"), F.when(F.col("columns"), F.coalesce("x_next", "right")).otherwise(F.col("right")).alias("right"),
            F.when(F.col("bands"), F.coalesce("br_cut", "top")).otherwise(F.col("top")).alias("top"), F.when(F.col("bands"), F.coalesce("b_next", "bottom")).otherwise(F.col("bottom")).alias("bottom"),
        ))
        found = moved.where("not columns and not bands").select(*keep)
        done = found if done is None else done.unionByName(found)
        cur = moved.where("columns or bands").select(*keep)
        if cur.isEmpty():
            break
    figure = F.max(~F.coalesce(F.col("label").isin(*TEXT_LABELS), F.lit(False))).over(Window.partitionBy(*node))
    return done.withColumn("kind", F.when(figure, "figure").otherwise(F.col("kind"))).withColumnRenamed("page", page)


#: Levels of the grid in which boxes meet: a box lies in at most four cells of the level of its size.
_LEVELS = 40


def overlap_links(boxes: DataFrame) -> DataFrame:
    """(a, b): for each box (page, id, x0, y0, x1, y1) that overlaps smaller or equally large ones, a link to the first
    of them in each grid cell; every box that overlaps another has a link.

    A box is entered at the level of its size, and asked for at that level and all above that the page has, so no box is
    copied to all the cells that it covers.
    """
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.greatest(F.ceil(F.log2(F.greatest(size.cast("double"), F.lit(1e-9)))), F.lit(-_LEVELS)).cast("int")
    boxes = boxes.where("x0 < x1 AND y0 < y1").withColumn("level", level)
    used = boxes.groupBy("page").agg(F.array_sort(F.collect_set("level")).alias("levels"))

    def cells(at: Column) -> Column:
        step = F.pow(F.lit(2.0), at)
        return F.flatten(F.transform(F.sequence(F.floor(F.col("x0") / step), F.floor(F.col("x1") / step)), lambda cx: F.transform(F.sequence(F.floor(F.col("y0") / step), F.floor(F.col("y1") / step)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))

    entered = boxes.withColumn("c", F.explode(cells(F.col("level")))).select("page", "level", "c.cx", "c.cy", *(F.col(n).alias(f"e_{n}") for n in ("id", "x0", "y0", "x1", "y1")))
    asked = boxes.join(used, "page").withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).withColumn("c", F.explode(cells(F.col("at"))))
    asked = asked.select("page", F.col("at").alias("level"), "c.cx", "c.cy", "id", "x0", "y0", "x1", "y1")
    over = (F.greatest("x0", "e_x0") < F.least("x1", "e_x1")) & (F.greatest("y0", "e_y0") < F.least("y1", "e_y1")) & (F.col("id") != F.col("e_id"))
    return asked.join(entered, ["page", "level", "cx", "cy"]).where(over).groupBy("id", "page", "level", "cx", "cy").agg(F.min("e_id").alias("b")).select(F.col("id").alias("a"), "b").distinct()


#: Boxes of a page behind the sweep that a grown one may still meet in its task.
BEHIND = 2000


def _swept(batches, behind_most: int):
    """Unites overlapping boxes of a sorted stretch: each box with the open ones it meets, and as it grows with those just
    behind the sweep. What it meets further behind is left to the links."""
    page, open_, behind = None, [], []
    names = ["page", "id", "x0", "y0", "x1", "y1", "n"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()))], names=names)

    meet = lambda a, o: max(a[2], o[2]) < min(a[4], o[4]) and max(a[3], o[3]) < min(a[5], o[5])
    for b in batches:
        out = []
        for box in zip(*(b.column(k).to_pylist() for k in range(7))):
            if box[0] != page:
                out += open_ + behind
                page, open_, behind = box[0], [], []
            x0 = box[2]
            behind += [o for o in open_ if o[4] <= x0]
            open_ = [o for o in open_ if o[4] > x0]
            if len(behind) > 2 * behind_most:
                out += behind[:-behind_most]
                behind = behind[-behind_most:]
            met = [o for o in open_ if meet(box, o)]
            while met:
                gone = {id(o) for o in met}
                open_, behind = [o for o in open_ if id(o) not in gone], [o for o in behind if id(o) not in gone]
                both = [box, *met]
                box = (page, min(x[1] for x in both), min(x[2] for x in both), min(x[3] for x in both), max(x[4] for x in both), max(x[5] for x in both), sum(x[6] for x in both))
                met = [o for o in (*open_, *behind) if meet(box, o)]
            open_.append(box)
        yield batch(out)
    yield batch(open_ + behind)


def united_regions(boxes: DataFrame, page: str = "page") -> DataFrame:
    """(page, id, x0, y0, x1, y1, n): regions of boxes (page, id, x0 to y1) that overlap, directly or through what they
    grow to; id is the smallest of the n boxes in it. Boxes that only touch stay apart, boxes without an area, too.

    Each round unites what a sweep over stretches of a page sees, then links what is left and unites by components, until
    no two regions overlap. A round at least halves the regions of a cluster, so rounds grow with the logarithm of a
    chain. Boxes with a null coordinate take no part; ids tell boxes apart; page and id are integers.
    """
    cur = boxes.select(F.col(page).cast("long").alias("page"), F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(1).cast("long").alias("n")).where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    schema = "page long, id long, x0 double, y0 double, x1 double, y1 double, n long"
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        before = cur
        cur = materialize(cur.repartitionByRange(parts, "page", "x0", "id").sortWithinPartitions("page", "x0", "id").mapInArrow(lambda batches, n=BEHIND: _swept(batches, n), schema))
        found = materialize(overlap_links(cur.drop("n")))
        if found.isEmpty():
            break
        label = components(found.withColumnsRenamed({"a": "src", "b": "dst"}))
        label = label.groupBy("node").agg(F.min("component").alias("component"))
        merged = cur.join(label, F.col("id") == F.col("node"), "left").withColumn("id", F.coalesce("component", "id"))
        joined = materialize(merged.groupBy("page", "id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n")))
        for old in (before, cur, found):
            discard(old)
        cur = joined
    return cur.withColumnRenamed("page", page)


def anchored(regions: DataFrame, items: DataFrame, page: str) -> DataFrame:
    """(page, region, at): the number of the item (page, nth from 0, x0 to y1, furniture) before which each region (page,
    region, x0 to y1) is read; the number of items for the end.

    Items of the body bound a region: it follows the last one above it in its columns and precedes the first below it,
    and in between follows all that are not wholly to its right. Without items in its columns it follows the last one
    above it, else what lies wholly to its left if something there is beside it, else it heads the body. Running heads
    and feet place a region only on a page that has nothing else. Regions and items of a page meet.
    """
    w = Window.partitionBy(page)
    body = items.withColumns({"only": F.min(F.col("furniture").cast("int")).over(w) == 1, "total": F.count("*").over(w)}).where("only or not furniture")
    body = body.select(page, "nth", "total", *(F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")))
    both = regions.select(page, "region", "x0", "y0", "x1", "y1").join(body, page, "left")
    spans = F.greatest("x0", "i_x0") < F.least("x1", "i_x1")
    over, under, left = F.col("i_y1") <= F.col("y0"), F.col("i_y0") >= F.col("y1"), F.col("i_x1") <= F.col("x0")
    beside = (F.col("i_y0") < F.col("y1")) & (F.col("y0") < F.col("i_y1"))
    by = [page, "region"]
    seen = lambda f, when: f(F.when(when, F.col("nth")))
    facts = both.groupBy(*by).agg(
        F.max("total").alias("total"), seen(F.max, spans & over).alias("above_in"), seen(F.min, spans & under).alias("below_in"), seen(F.max, over).alias("above"),
        F.max(left & beside).alias("left_beside"), seen(F.max, left).alias("left"), F.min("nth").alias("first"),
    )
    bounded = F.col("above_in").isNotNull() & (F.col("below_in").isNull() | (F.col("above_in") < F.col("below_in")))
    end = F.coalesce("below_in", "total")
    passed = both.join(facts.where(bounded).select(*by, (F.col("above_in") + 1).alias("from"), end.alias("to")), by).where((F.col("nth") >= F.col("from")) & (F.col("nth") < F.col("to")) & (F.col("i_x0") < F.col("x1")))
    facts = facts.join(passed.groupBy(*by).agg((F.max("nth") + 1).alias("passed")), by, "left")
    at = (
        F.when(bounded, F.greatest(F.col("above_in") + 1, "passed")).when(F.col("below_in").isNotNull(), F.col("below_in")).when(F.col("above").isNotNull(), F.col("above") + 1)
        .when(F.col("left_beside"), F.col("left") + 1).otherwise(F.coalesce("first", F.lit(0)))
    )
    return facts.select(*by, at.cast("long").alias("at"))


def spliced(items: DataFrame, placed: DataFrame, page: str) -> DataFrame:
    """(page, key, item, region): items and regions in one order. key sorts them, an item's (nth, 1, 0) and a region's
    (at, 0, region), so a region goes between two items without a new number for any."""
    none = F.lit(None).cast("long")
    key = lambda a, b, c: F.struct(a.cast("long").alias("at"), F.lit(b).alias("after"), c.cast("long").alias("nth")).alias("key")
    mine = items.select(page, key(F.col("nth"), 1, F.lit(0)), F.col("nth").cast("long").alias("item"), none.alias("region"))
    return mine.union(placed.select(page, key(F.col("at"), 0, F.col("region")), none.alias("item"), F.col("region").cast("long").alias("region")))


def _boxes(spark, sf, a_page: int) -> DataFrame:
    """Parts as boxes of a page of 300 by 400, every ninth one wide, every eleventh a picture."""
    k = F.col("p_partkey")
    x, y = k * 37 % 240, k * 91 % 380
    wide = k % 9 == 0
    return T(spark, sf, "part").select(
        F.floor(k / a_page).cast("bigint").alias("page"), k.alias("id"), F.when(wide, 0).otherwise(x).alias("x0"), y.alias("y0"),
        F.when(wide, 290).otherwise(x + F.col("p_size") + 8).alias("x1"), (y + F.col("p_size") % 9 + 5).alias("y1"), F.when(k % 11 == 0, "picture").otherwise("text").alias("label"),
    )


def page_cuts(spark, sf):
    """The leaf of every box in the recursive cut of its page."""
    return page_leaves(_boxes(spark, sf, 8), "page", 300, 400).select("page", "id", F.array_join(F.transform("node", lambda x: x.cast("string")), ".").alias("node"), "kind", "left", "right", "top", "bottom")


def united_boxes(spark, sf):
    return united_regions(_boxes(spark, sf, 60)).withColumns({c: F.col(c).cast("bigint") for c in ("x0", "y0", "x1", "y1")})


def placed_pictures(spark, sf):
    """Pictures of a page among its other boxes, in the order of both; every thirteenth box is furniture."""
    b = _boxes(spark, sf, 12).withColumn("furniture", F.col("id") % 13 == 0)
    items = b.where("label = 'text'").withColumn("nth", (F.row_number().over(Window.partitionBy("page").orderBy("x0", "y0", "id")) - 1).cast("bigint"))
    return anchored(b.where("label <> 'text'").withColumnRenamed("id", "region"), items, "page")


QUERIES = {f.__name__: f for f in (page_cuts, united_boxes, placed_pictures)}
_B = """b AS (SELECT (p_partkey // {n}) AS page, p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_partkey * 37 % 240 END AS x0, p_partkey * 91 % 380 AS y0,
        CASE WHEN p_partkey % 9 = 0 THEN 290 ELSE p_partkey * 37 % 240 + p_size + 8 END AS x1, p_partkey * 91 % 380 + p_size % 9 + 5 AS y1, p_partkey % 11 = 0 AS picture FROM part)"""
ORACLES = {
    # children are found by counting the cuts left of (above) a box, cuts by asking each edge whether anything spans the gap
    "page_cuts": "WITH RECURSIVE " + _B.replace("{n}", "8") + f""",
        t AS (
            SELECT page, id, x0, y0, x1, y1, picture, '' AS node, 'page' AS kind, 0::DOUBLE AS l, 300::DOUBLE AS r, 0::DOUBLE AS t, 400::DOUBLE AS b, true AS open FROM b
            UNION ALL
            SELECT page, id, x0, y0, x1, y1, picture, node || CASE WHEN nx > 0 THEN '.' || len(lx) WHEN nb > 0 THEN '.' || len(lb) ELSE '' END, CASE WHEN nx > 0 THEN 'column' WHEN nb > 0 THEN 'band' ELSE kind END,
                CASE WHEN nx > 0 THEN coalesce(list_max(lx), l) ELSE l END, CASE WHEN nx > 0 THEN coalesce(list_min(list_filter(cx, lambda c: c > x0)), r) ELSE r END,
                CASE WHEN nx = 0 AND nb > 0 THEN coalesce(list_max(lb), t) ELSE t END, CASE WHEN nx = 0 AND nb > 0 THEN coalesce(list_min(list_filter(cb, lambda c: c > y0)), b) ELSE b END, nx > 0 OR nb > 0
            FROM (SELECT *, list_filter(cx, lambda c: c < x0) AS lx, list_filter(cb, lambda c: c < y0) AS lb, len(cx) AS nx, len(cb) AS nb FROM (
                SELECT w.*, gaps.cx, CASE WHEN gaps.anywide AND gaps.inner_gap THEN gaps.cb ELSE [] END AS cb FROM t w JOIN (
                    SELECT page, node, coalesce(list(DISTINCT (x0 + px) / 2) FILTER (x0 - px > {MIN_GAP}), []) AS cx, bool_or(wide) AS anywide, coalesce(bool_or(NOT wide AND x0 - pn > {MIN_GAP}), false) AS inner_gap,
                        coalesce(list(DISTINCT (y0 + py) / 2) FILTER (y0 - py > {MIN_GAP} AND (hw OR pw)), []) AS cb FROM (
                        SELECT *, lag(hw) OVER (PARTITION BY page, node ORDER BY y0, y1, id) AS pw FROM (
                            SELECT *, bool_or(wide) OVER (PARTITION BY page, node, band) AS hw FROM (
                                SELECT *, count(*) FILTER (y0 - py > {MIN_GAP}) OVER (PARTITION BY page, node ORDER BY y0, y1, id) AS band, max(x1) OVER (PARTITION BY page, node, wide ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn FROM (
                                    SELECT *, x1 - x0 >= {SPAN} * (max(x1) OVER p - min(x0) OVER p) AS wide, max(x1) OVER (PARTITION BY page, node ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS px,
                                        max(y1) OVER (PARTITION BY page, node ORDER BY y0, y1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS py FROM t WHERE open WINDOW p AS (PARTITION BY page, node))))) GROUP BY page, node) gaps ON gaps.page = w.page AND gaps.node = w.node
                WHERE w.open)))
        SELECT page, id, ltrim(node, '.') AS node, CASE WHEN bool_or(picture) OVER (PARTITION BY page, node) THEN 'figure' ELSE kind END AS kind, l AS left, r AS right, t AS top, b AS bottom FROM t WHERE NOT open""",
    # each step unites a region with the first that it overlaps; 60 boxes of a page take no more steps
    "united_boxes": "WITH RECURSIVE " + _B.replace("{n}", "60") + """, w AS (SELECT 0 AS step, page, id, x0, y0, x1, y1, 1::BIGINT AS n FROM b
            UNION ALL SELECT step + 1, page, min(id), min(x0), min(y0), max(x1), max(y1), sum(n)::BIGINT FROM (
                SELECT w.*, coalesce((SELECT min(o.id) FROM w o WHERE o.page = w.page AND greatest(o.x0, w.x0) < least(o.x1, w.x1) AND greatest(o.y0, w.y0) < least(o.y1, w.y1)), w.id) AS g FROM w WHERE step < 60) GROUP BY step, page, g)
        SELECT page, id, x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, y1::BIGINT AS y1, n FROM w WHERE step = 60""",
    "placed_pictures": "WITH " + _B.replace("{n}", "12") + """, i AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x0, y0, id) - 1 AS nth, id % 13 = 0 AS f FROM b WHERE NOT picture),
        k AS (SELECT * FROM i WHERE NOT f OR page NOT IN (SELECT page FROM i WHERE NOT f)),
        q AS (SELECT r.page, r.id AS region, r.x0, r.y0, r.x1, r.y1, (SELECT count(*) FROM i WHERE i.page = r.page) AS total,
            (SELECT max(nth) FROM k WHERE k.page = r.page AND greatest(k.x0, r.x0) < least(k.x1, r.x1) AND k.y1 <= r.y0) AS a, (SELECT min(nth) FROM k WHERE k.page = r.page AND greatest(k.x0, r.x0) < least(k.x1, r.x1) AND k.y0 >= r.y1) AS z,
            (SELECT max(nth) FROM k WHERE k.page = r.page AND k.y1 <= r.y0) AS up, (SELECT max(nth) FROM k WHERE k.page = r.page AND k.x1 <= r.x0) AS lf,
            EXISTS (SELECT 1 FROM k WHERE k.page = r.page AND k.x1 <= r.x0 AND k.y0 < r.y1 AND r.y0 < k.y1) AS beside, (SELECT min(nth) FROM k WHERE k.page = r.page) AS f FROM b r WHERE picture)
        SELECT page, region, CASE WHEN a IS NOT NULL AND (z IS NULL OR a < z) THEN greatest(a + 1, coalesce((SELECT max(nth) + 1 FROM k WHERE k.page = q.page AND nth > a AND nth < coalesce(z, total) AND k.x0 < q.x1), 0))
            WHEN z IS NOT NULL THEN z WHEN up IS NOT NULL THEN up + 1 WHEN beside THEN lf + 1 ELSE coalesce(f, 0) END AS at FROM q""",
}
