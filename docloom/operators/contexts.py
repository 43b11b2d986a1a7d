"""Contexts for reading a document in parts: whole passages with one owner each, and windows of units beside what
surrounds them. Both are folds with a bounded look-back: what is held is one part, not a document."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.folds import PASSAGE_COST, fold_in_order
from docloom.sources.tables import read_table as T

#: Labels of headings, of running heads and feet, and of what belongs to a table beside it. Fixed values.
HEADINGS, FURNITURE, BESIDE_TABLES = ("Title", "SectionHeader"), ("PageHeader", "PageFooter"), ("Caption", "Footnote")


def structural_ends(passages: DataFrame, doc: str, pos: str, label: str = "label") -> DataFrame:
    """Adds `free`: whether a part may end before the passage. A heading stays with the next passage that is neither heading
    nor furniture, a table with the captions, notes and furniture around it; a document's first passage is not free."""
    w = Window.partitionBy(doc).orderBy(pos)
    behind, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    name, aside = F.coalesce(label, F.lit("")), (*FURNITURE, *BESIDE_TABLES)
    body_behind = F.last(F.when(~name.isin(*FURNITURE), name), True).over(behind)
    solid = F.when(~name.isin(*aside), name)
    after_table = name.isin(*aside) & (F.last(solid, True).over(behind) == "Table")
    before_table = F.lag(name).over(w).isin(*aside) & (F.first(solid, True).over(ahead) == "Table")
    held = F.coalesce(body_behind.isin(*HEADINGS), F.lit(False)) | F.coalesce(after_table, F.lit(False)) | F.coalesce(before_table, F.lit(False))
    return passages.withColumn("free", ~held & F.lag(pos).over(w).isNotNull())


def context_partition(passages: DataFrame, doc: str, pos: str, cost: str, most: int, overlap: int = 0, structural: bool = True, label: str = "label") -> DataFrame:
    """(doc, context, pos, part): every passage is `primary` in one context, in order; `overlap` ones before it are shown
    again as far as they fit, and with structural the last heading before it as `heading`.

    A context ends at the last free place up to which it fits `most`, or at the first one if none fits, so an indivisible
    part beyond it stands whole. With structural, free places are those of structural_ends, and a context that isn't the
    last ends before the last heading in reach rather than amid a section. Positions tell a document's passages apart; a null
    label is plain text. Held at a time: one context and the passages up to the next free place.
    """
    rows = structural_ends(passages.select(doc, pos, cost, label), doc, pos, label) if structural else passages.select(doc, pos, cost, F.lit("").alias(label), F.lit(True).alias("free"))
    rows = rows.select(F.col(doc).cast("long").alias("doc"), F.col(pos).cast("long").alias("pos"), F.col(cost).cast("long").alias("cost"), F.coalesce(label, F.lit("")).alias("label"), "free")

    def start(values):
        held: list = []
        past: deque = deque(maxlen=max(overlap, 1))
        state = {"n": 0, "heading": None, "total": 0}

        def close(end: int):
            """Makes a context of the first `end` held passages."""
            primary = held[:end]
            head = None if primary[0].label in HEADINGS else state["heading"]
            extra = list(past)[-overlap:] if overlap else []
            room = most - sum(x.cost for x in primary)
            while extra and sum(x.cost for x in extra) + (head.cost if head is not None and head.pos not in {x.pos for x in extra} else 0) > room:
                extra = extra[1:]
            state["n"] += 1
            parts = [("overlap", x) for x in extra] + [("primary", x) for x in primary]
            if head is not None and head.pos not in {x.pos for x in extra}:
                parts = [("heading", head), *parts]
            past.extend(primary)
            heads = [x for x in primary if x.label in HEADINGS]
            state["heading"] = heads[-1] if structural and heads else state["heading"]
            del held[:end]
            state["total"] -= sum(x.cost for x in primary)
            return [(values[0], state["n"], x.pos, part) for part, x in parts]

        def feed(row):
            out = []
            if row is not None:
                held.append(row)
                state["total"] += row.cost
            while held:
                base = 0 if held[0].label in HEADINGS or state["heading"] is None else state["heading"].cost
                if row is not None and base + state["total"] <= most:
                    return out
                ends = [i for i in range(1, len(held)) if held[i].free] + ([len(held)] if row is None else [])
                if not ends:
                    return out
                used, size, fit = base, 0, ends[0]
                for end in ends:
                    used += sum(x.cost for x in held[size:end])
                    size = end
                    if used > most:
                        break
                    fit = end
                if structural and not (row is None and fit == len(held)):
                    sections = [i for i in ends if i <= fit and i < len(held) and held[i].label in HEADINGS]
                    fit = sections[-1] if sections else fit
                out += close(fit)
            return out

        return feed

    out = fold_in_order(rows, ["doc"], ["pos"], start, "doc bigint, context bigint, pos bigint, part string")
    return out.withColumnsRenamed({"doc": doc, "pos": pos})


def context_windows(units: DataFrame, doc: str, pos: str, cost: str, most: int, overlap: int, group: str | None = None, heading: str | None = None) -> DataFrame:
    """(doc, window, pos, part, omitted): windows over the units of a document, each with as many `primary` units as fit
    `most` beside `overlap` units `before` and `after` it and its heading's cost (of its first unit).

    Windows stay within a run of one group; what surrounds them doesn't. A unit that fits only alone loses the heading
    first, then the units after it, then those before it; `omitted` names what was left out. A unit above `most` stands
    alone with all omitted. Held at a time: one window with what surrounds it.
    """
    rows = units.select(F.col(doc).cast("long").alias("doc"), F.col(pos).cast("long").alias("pos"), F.col(cost).cast("long").alias("cost"), (F.col(group).cast("string") if group else F.lit("")).alias("grp"), (F.coalesce(F.col(heading).cast("long"), F.lit(0)) if heading else F.lit(0)).alias("head"))

    def start(values):
        held: list = []
        past: deque = deque(maxlen=max(overlap, 1))
        state = {"n": 0, "total": 0}

        def close(end: int, omitted: list[str]):
            state["n"] += 1
            before = [] if "before" in omitted or not overlap else list(past)
            after = [] if "after" in omitted else held[end : end + overlap]
            out = [(values[0], state["n"], x.pos, part, omitted) for part, xs in (("before", before), ("primary", held[:end]), ("after", after)) for x in xs]
            past.extend(held[:end])
            state["total"] -= sum(x.cost for x in held[:end])
            del held[:end]
            return out

        def feed(row):
            out = []
            if row is not None:
                held.append(row)
                state["total"] += row.cost
            final = row is None
            while held:
                before = sum(x.cost for x in past) if overlap else 0
                base = before + held[0].head
                run = next((i for i, x in enumerate(held) if x.grp != held[0].grp), len(held))
                if not final and run == len(held) and base + state["total"] <= most:
                    return out
                fit, used, seen, known = 0, base, 0, True
                for end in range(1, run + 1):
                    if not final and len(held) < end + overlap:
                        known = False
                        break
                    used, seen = used + sum(x.cost for x in held[seen : end + overlap]), max(seen, min(end + overlap, len(held)))
                    if used > most:
                        break
                    fit = end
                else:
                    known = final or run < len(held)
                if not known:
                    return out
                if fit:
                    out += close(fit, [])
                    continue
                after = sum(x.cost for x in held[1 : 1 + overlap])
                ladder = ((["heading"], before + after), (["heading", "after"], before), (["heading", "after", "before"], 0))
                out += close(1, next((left for left, around in ladder if held[0].cost + around <= most), ladder[-1][0]))
            return out

        return feed

    out = fold_in_order(rows, ["doc"], ["pos"], start, "doc bigint, window bigint, pos bigint, part string, omitted array<string>")
    return out.withColumnsRenamed({"doc": doc, "pos": pos})


def _turns(spark, sf) -> DataFrame:
    """Turns as passages: some are headings, captions, tables, running heads."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    k = F.col("pos") * 5 + F.col("conv_id")
    label = F.element_at(F.array(*map(F.lit, ("Text", "Title", "Text", "Caption", "Table", "Text", "PageHeader", "SectionHeader", "Footnote", "Text", "Text"))), (k % 11 + 1).cast("int"))
    return T(spark, sf, "conversations").select("conv_id", at.cast("bigint").alias("pos"), (F.coalesce(F.length("text"), F.lit(0)) + PASSAGE_COST).cast("bigint").alias("cost")).withColumn("label", label)


def turn_contexts(spark, sf):
    return context_partition(_turns(spark, sf), "conv_id", "pos", "cost", 500, 1)


def turn_windows(spark, sf):
    units = _turns(spark, sf).withColumn("grp", F.floor((F.col("pos") - 1) / 5)).withColumn("head", F.col("conv_id") % 3 * 40)
    return context_windows(units, "conv_id", "pos", "cost", 500, 1, "grp", "head").withColumn("omitted", F.array_join("omitted", ","))


QUERIES = {f.__name__: f for f in (turn_contexts, turn_windows)}
_T = f"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, coalesce(length(text), 0) + {PASSAGE_COST} AS cost FROM conversations),
    p AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM t)"""
ORACLES = {
    # the end of each window follows from prefix sums; windows follow each other by recursion
    "turn_windows": f"""WITH RECURSIVE {_T}, s AS (SELECT a.conv_id, a.pos AS first, a.cost, (a.conv_id % 3) * 40 AS head, a.n,
            (SELECT coalesce(max(b.upto), 0) FROM p b WHERE b.conv_id = a.conv_id AND b.pos <= a.pos - 2) AS base, a.upto - a.cost AS own,
            (SELECT max(b.upto) FROM p b WHERE b.conv_id = a.conv_id AND b.pos <= a.pos + 1) AS next1,
            (SELECT max(e.pos) FROM p e JOIN p x ON x.conv_id = e.conv_id AND x.pos = least(e.pos + 1, e.n) WHERE e.conv_id = a.conv_id AND e.pos >= a.pos AND (e.pos - 1) // 5 = (a.pos - 1) // 5
                AND x.upto - (SELECT coalesce(max(b.upto), 0) FROM p b WHERE b.conv_id = a.conv_id AND b.pos <= a.pos - 2) + (a.conv_id % 3) * 40 <= 500) AS fit FROM p a),
        w AS (SELECT conv_id, first, coalesce(fit, first) AS last, 1::BIGINT AS win, fit, n, base, own, cost, next1 FROM s WHERE first = 1
            UNION ALL SELECT s.conv_id, s.first, coalesce(s.fit, s.first), win + 1, s.fit, s.n, s.base, s.own, s.cost, s.next1 FROM w JOIN s ON s.conv_id = w.conv_id AND s.first = w.last + 1),
        o AS (SELECT *, CASE WHEN fit IS NOT NULL THEN '' WHEN next1 - base <= 500 THEN 'heading' WHEN own + cost - base <= 500 THEN 'heading,after' ELSE 'heading,after,before' END AS omitted FROM w)
        SELECT o.conv_id, win AS window, p.pos, CASE WHEN p.pos < first THEN 'before' WHEN p.pos > last THEN 'after' ELSE 'primary' END AS part, omitted
        FROM o JOIN p ON p.conv_id = o.conv_id AND p.pos BETWEEN first - 1 AND last + 1 WHERE NOT (p.pos < first AND contains(omitted, 'before')) AND NOT (p.pos > last AND contains(omitted, 'after'))""",
    "turn_contexts": f"""WITH RECURSIVE {_T}, l AS (SELECT *, ['Text', 'Title', 'Text', 'Caption', 'Table', 'Text', 'PageHeader', 'SectionHeader', 'Footnote', 'Text', 'Text'][(pos * 5 + conv_id) % 11 + 1] AS label FROM p),
        h AS (SELECT *, label IN ('Title', 'SectionHeader') AS head, label IN ('PageHeader', 'PageFooter') AS furn, label IN ('PageHeader', 'PageFooter', 'Caption', 'Footnote') AS aside FROM l),
        f AS (SELECT a.*, pos > 1 AND NOT coalesce((SELECT arg_max(b.head, b.pos) FROM h b WHERE b.conv_id = a.conv_id AND b.pos < a.pos AND NOT b.furn), false)
                AND NOT (aside AND coalesce((SELECT arg_max(b.label, b.pos) FROM h b WHERE b.conv_id = a.conv_id AND b.pos < a.pos AND NOT b.aside), '') = 'Table')
                AND NOT (coalesce((SELECT b.aside FROM h b WHERE b.conv_id = a.conv_id AND b.pos = a.pos - 1), false) AND coalesce((SELECT arg_min(b.label, b.pos) FROM h b WHERE b.conv_id = a.conv_id AND b.pos >= a.pos AND NOT b.aside), '') = 'Table') AS free FROM h a),
        e AS (SELECT conv_id, pos AS first, pos, head FROM f WHERE free UNION ALL SELECT conv_id, n + 1, n + 1, false FROM f WHERE pos = 1),
        c AS (SELECT a.conv_id, a.pos AS first, e.first AS stop, e.head, hd.pos AS hpos, coalesce(hd.cost, 0) AS hcost, z.upto - a.upto + a.cost AS size, a.n
            FROM f a JOIN e ON e.conv_id = a.conv_id AND e.first > a.pos JOIN f z ON z.conv_id = a.conv_id AND z.pos = e.first - 1
            LEFT JOIN f hd ON NOT a.head AND hd.conv_id = a.conv_id AND hd.pos = (SELECT max(b.pos) FROM f b WHERE b.conv_id = a.conv_id AND b.pos < a.pos AND b.head)),
        g AS (SELECT conv_id, first, any_value(n) AS n, any_value(hpos) AS hpos, any_value(hcost) AS hcost, coalesce(max(stop) FILTER (hcost + size <= 500), min(stop)) AS fit FROM c GROUP BY conv_id, first),
        k AS (SELECT g.*, CASE WHEN fit <= n THEN coalesce((SELECT max(stop) FROM c WHERE c.conv_id = g.conv_id AND c.first = g.first AND stop <= fit AND c.head), fit) ELSE fit END AS stop FROM g),
        w AS (SELECT conv_id, first, stop, hpos, hcost, 1::BIGINT AS ctx FROM k WHERE first = 1 UNION ALL SELECT k.conv_id, k.first, k.stop, k.hpos, k.hcost, ctx + 1 FROM w JOIN k ON k.conv_id = w.conv_id AND k.first = w.stop),
        r AS (SELECT w.*, (SELECT sum(cost) FROM f WHERE f.conv_id = w.conv_id AND f.pos >= w.first AND f.pos < w.stop) AS own, b.pos AS bpos, b.cost AS bcost FROM w LEFT JOIN f b ON b.conv_id = w.conv_id AND b.pos = w.first - 1),
        v AS (SELECT *, bpos IS NOT NULL AND own + bcost + CASE WHEN hpos IS NULL OR hpos = bpos THEN 0 ELSE hcost END <= 500 AS shown FROM r)
        SELECT v.conv_id, ctx AS context, f.pos, 'primary' AS part FROM v JOIN f ON f.conv_id = v.conv_id AND f.pos >= v.first AND f.pos < v.stop
        UNION ALL SELECT conv_id, ctx, bpos, 'overlap' FROM v WHERE shown UNION ALL SELECT conv_id, ctx, hpos, 'heading' FROM v WHERE hpos IS NOT NULL AND NOT (shown AND hpos = bpos)""",
}
