"""Routed lines to blocks: who owns each line, why a line has no owner, and a ledger that accounts for every line once.

Lines of a document come in reading order with a kind. The owner of a line is the last event before it: entry starts
open a block; headings, sections, scoped numbers and starts that the numbering doesn't explain end it. Only the roles of
numbered starts need a pass with look-ahead (`folds.start_roles`); all else is windows over documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.folds import fold_in_order, start_roles
from docloom.operators.quotes import View, places
from docloom.sources.tables import read_table as T
from docloom.sources.tables import tasks_for

#: Kinds of lines that end an open entry, and kinds that a reader sees around an entry. Fixed values.
ENDS = ("heading", "section", "hint", "unclassified_heading", "series")
VISIBLE = ("content", "candidate", "heading", "section", "hint", "unclassified_heading", "series", "glossary", "reference", "excluded_region")
#: Columns of a routed line. level, heading, heading_kind: of headings. lost: a list item printed without its marker.
LINE = "doc long, pos long, segment string, start long, stop long, kind string, number long, suffix string, label string, restart boolean, level int, heading string, heading_kind string, region string, status string, lost boolean, list_item boolean, inline array<long>, page long, unit long, crop long"
CONTEXT_LINES, CONTEXT_CHARS = 2, 400


def lines_of(df: DataFrame, **columns: Column) -> DataFrame:
    """A frame of routed lines: the columns of LINE, null (false for flags) where neither df nor `columns` has them."""
    have = {c: F.col(c) for c in df.columns} | columns
    out = []
    for spec in LINE.split(", "):
        name, kind = spec.split(" ")
        c = have.get(name, F.lit(None)).cast(kind)
        out.append((F.coalesce(c, F.lit(False)) if kind == "boolean" else F.coalesce(c, F.lit("")) if name == "suffix" else c).alias(name))
    return df.select(*out)


def _in(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _main() -> Column:
    return (F.col("kind") == "candidate") & ~F.col("restart")


def _upto(last: int = 0):
    return Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, last)


def resolved_starts(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """The lines with `options`: for each numbered start that doesn't restart, the roles it has in some reading with the
    fewest exceptions, sorted and joined by +. The starts of one document at a time are held; lines aren't. tasks: how
    many the rows are dealt to (`tasks_for`), else the session's number."""
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    counted = lines.withColumn("__run", F.count_if(_main()).over(_upto())).withColumn("__walls", F.count_if(_in(*ENDS)).over(_upto()))
    numbers = F.when(_in("content") | _main(), F.col("inline"))
    written = counted.where(F.size(numbers) > 0).groupBy("doc", (F.col("__run") + 1).alias("__run")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "inline"))), lambda x: x["inline"])).alias("written"))
    w = Window.partitionBy("doc").orderBy("pos")
    starts = counted.where(_main()).select("doc", "pos", "number", "suffix", "__run", (F.col("__walls") != F.lag("__walls", 1, 0).over(w)).alias("barrier"))
    starts = dealt(starts, "doc", "__run").join(dealt(written, "doc", "__run"), ["doc", "__run"], "left").select("doc", "pos", "number", "suffix", "barrier", "written")

    def begin(values):
        seen = []

        def feed(row):
            if row is not None:
                seen.append((row.pos, int(row.number), row.suffix, bool(row.barrier), [] if row.written is None else [int(x) for x in row.written]))
                return []
            roles = start_roles([x[1] for x in seen], [x[2] for x in seen], [x[3] for x in seen], [x[4] for x in seen])
            return [(values[0], x[0], role) for x, role in zip(seen, roles)]

        return feed

    roles = fold_in_order(starts, ["doc"], ["pos"], begin, "doc bigint, pos bigint, options string", tasks)
    return dealt(dealt(lines, "doc", "pos").join(dealt(roles, "doc", "pos"), ["doc", "pos"], "left"), "doc")


def disposed(lines: DataFrame) -> DataFrame:
    """The lines with role, reason, block (number of the entry, or null) and what the diagnostics need.

    A line has one role: entry, heading, glossary, reference, figure, excluded or unresolved. Columns besides:
    opens (starts a block), refused (a start that is no entry), lost_here (a list item without its marker ends the
    block), last_entry (of the lines before), after_gap (something unresolved since that entry). A document is a
    window partition. Rows with equal (doc, pos) are no input: a position is one line.
    """
    entry = _main() & F.col("options").eqNullSafe("entry")
    listed = _main() & F.col("options").eqNullSafe("list_item")
    scoped = _in("series") | (_in("candidate") & F.col("restart"))
    stop = _in("heading", "section", "hint", "unclassified_heading")
    df = lines.withColumns({"opens": entry, "listed": listed, "scoped": scoped, "stop_line": stop})
    df = df.withColumn("stretch", F.count_if(entry | scoped | stop | (_main() & ~entry & ~listed)).over(_upto()))
    inside = Window.partitionBy("doc", "stretch")
    # in a stretch, the block that its first line opens goes on to the first lost marker
    df = df.withColumns({"opened": F.max("opens").over(inside), "lost_at": F.min(F.when(_in("content") & F.col("lost"), F.col("pos"))).over(inside)})
    df = df.withColumn("inside", F.col("opened") & (F.col("lost_at").isNull() | (F.col("pos") < F.col("lost_at"))))
    identity = F.struct("number", "suffix")
    df = df.withColumns({
        "lost_here": F.col("opened") & F.col("pos").eqNullSafe(F.col("lost_at")),
        "refused": _main() & ~entry & ~(listed & F.col("inside")),
        "last_entry": F.last(F.when(entry, F.struct("number", "suffix", "label")), True).over(_upto(-1)),
        "alike": F.count_if(_main()).over(Window.partitionBy("doc", "number", "suffix")),
        "block": F.count_if(entry).over(_upto()),
    })
    before = F.struct(F.col("last_entry.number").alias("number"), F.col("last_entry.suffix").alias("suffix"))
    several = F.contains("options", F.lit("+"))
    why = (
        F.when(several & (F.col("alike") > 1) & F.contains("options", F.lit("exception")), "duplicate_identity").when(several, "ambiguous_start")
        .when(F.col("last_entry").isNotNull() & (before == identity), "duplicate_identity").when(F.col("last_entry").isNotNull() & (identity < before), "backward_label")
        .otherwise("sequence_exception")
    )
    df = df.withColumn("why", F.when(F.col("refused"), why))
    event = F.when(scoped, "scoped_identity_unsupported").when(F.col("refused"), F.col("why")).when(F.col("lost_here"), "unnumbered_item").when(entry | stop, "")
    troubles = F.count_if(F.col("refused") | F.col("lost_here")).over(_upto())
    df = df.withColumns({
        "state": F.last(event, True).over(_upto()), "troubles": troubles,
        "headed": F.coalesce(F.last(F.when(stop, True).when(entry, False), True).over(_upto()), F.lit(False)),
    })
    df = df.withColumn("after_gap", F.col("troubles") != F.last(F.when(entry, F.col("troubles")), True).over(_upto(-1)))
    owned = entry | (listed & F.col("inside")) | (_in("content") & F.col("inside"))
    plain = F.when(F.col("state") != "", F.col("state")).when(F.col("list_item"), "unnumbered_item").when(F.col("headed"), "orphan_after_heading").otherwise("orphan_before_first_entry")
    role = (
        F.when(_in("withheld", "duplicate", "furniture", "excluded_region"), "excluded").when(_in("section", "heading"), "heading").when(owned, "entry")
        .when(_in("figure", "glossary", "reference"), F.col("kind")).otherwise("unresolved")
    )
    reason = (
        F.when(_in("withheld"), F.concat(F.lit("segment_status:"), F.col("status"))).when(_in("duplicate"), "duplicate_observation").when(_in("furniture"), "furniture")
        .when(_in("excluded_region"), F.concat(F.lit("region:"), F.col("region"))).when(_in("section"), F.col("region")).when(_in("hint", "unclassified_heading"), "unclassified_heading")
        .when(scoped, "scoped_identity_unsupported").when(F.col("refused"), F.col("why")).when(_in("content") & ~owned, plain)
    )
    return df.withColumns({"role": role, "reason": reason, "block": F.when(owned, F.col("block"))}).drop("stretch", "opened", "lost_at", "inside", "alike", "state", "troubles", "headed", "listed", "stop_line")


def dispositions(done: DataFrame) -> DataFrame:
    """(doc, pos, segment, start, stop, role, reason, block): the ledger of lines."""
    return done.select("doc", "pos", "segment", "start", "stop", "role", "reason", "block")


def blocks(done: DataFrame, levels: dict[str, int]) -> DataFrame:
    """One row a block: (doc, block, label, number, suffix, lines, spans, continuation, headings, unsure).

    spans: the owned ranges, neighbouring lines of a segment as one if no other line of it lies between. continuation:
    the lines lie in more than one place (page, unit, crop). headings: the ids in force at the start, by level; a
    heading ends deeper ones, a section all, and kinds that an unclassified heading put in doubt (unsure) are left out.
    """
    placed = done.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "segment").orderBy("start", "pos")))
    own = Window.partitionBy("doc", "block").orderBy("pos")
    new = ~((F.lag("segment").over(own) == F.col("segment")) & (F.lag("nth").over(own) + 1 == F.col("nth")))
    rows = placed.where("block is not null").withColumn("span", F.count_if(F.coalesce(new, F.lit(True))).over(own))
    spans = rows.groupBy("doc", "block", "span").agg(F.first("segment").alias("segment"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"), F.collect_set(F.struct("page", "unit", "crop")).alias("at"))
    whole = spans.groupBy("doc", "block").agg(
        F.sum("n").alias("lines"), F.transform(F.array_sort(F.collect_list(F.struct("span", "segment", "start", "stop"))), lambda x: F.struct(x["segment"], x["start"], x["stop"])).alias("spans"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("at")))) > 1).alias("continuation"),
    )
    force, doubt = [], []
    hinted = F.last(F.when(_in("hint", "unclassified_heading"), F.col("pos")), True).over(_upto())
    marks = {}
    for level in sorted(set(levels.values())):
        event = F.when(_in("section"), F.struct("pos", F.lit(0).alias("level"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("heading_kind")))
        event = event.when(_in("heading") & (F.col("level") <= level), F.struct("pos", "level", "heading", "heading_kind"))
        marks[f"h{level}"] = F.last(event, True).over(_upto())
    known = done.withColumns(marks | {"hinted": hinted}).where("opens")
    for kind, level in sorted(levels.items()):
        unsure = F.col("hinted").isNotNull() & (F.col(f"h{level}").isNull() | (F.col("hinted") > F.col(f"h{level}.pos")))
        doubt.append(F.when(unsure, F.lit(kind)))
        force.append(F.when((F.col(f"h{level}.level") == level) & (F.col(f"h{level}.heading_kind") == kind) & ~unsure, F.struct(F.lit(level).alias("level"), F.col(f"h{level}.heading").alias("id"))))
    some = lambda cs, t: F.filter(F.array(*cs), lambda x: x.isNotNull()) if cs else F.array().cast(t)
    heads = F.transform(F.array_sort(some(force, "array<struct<level:int,id:string>>")), lambda x: x["id"])
    starts = known.select("doc", "block", "label", "number", "suffix", heads.alias("headings"), some(doubt, "array<string>").alias("unsure"))
    return starts.join(whole, ["doc", "block"]).select("doc", "block", "label", "number", "suffix", "lines", "spans", "continuation", "headings", "unsure")


def block_contexts(done: DataFrame, most_lines: int = CONTEXT_LINES, most_chars: int = CONTEXT_CHARS) -> DataFrame:
    """(doc, block, pos, segment, start, stop): up to most_lines visible lines before a block's first line and after its
    last, each clipped to most_chars next to the block."""
    seen = done.where(_in(*VISIBLE)).withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    ends = seen.where("block is not null").groupBy("doc", "block").agg(F.min("nth").alias("first"), F.max("nth").alias("last"))
    around = F.concat(*(F.array(*(F.struct((e + k).alias("nth"), F.lit(b).alias("before")) for k in ks)) for e, ks, b in ((F.col("first"), range(-most_lines, 0), True), (F.col("last"), range(1, most_lines + 1), False)) if ks))
    want = ends.select("doc", "block", F.explode(around).alias("x")).select("doc", "block", "x.*")
    start = F.when(F.col("before"), F.greatest("start", F.col("stop") - most_chars)).otherwise(F.col("start"))
    stop = F.when(F.col("before"), F.col("stop")).otherwise(F.least("stop", F.col("start") + most_chars))
    return want.join(seen.drop("block"), ["doc", "nth"]).select("doc", "block", "pos", "segment", start.alias("start"), stop.alias("stop"))


def diagnostics(done: DataFrame, built: DataFrame, max_gap: int = 5) -> DataFrame:
    """(doc, pos, code, detail): what a reader of the blocks has to know; pos is null for what concerns a document.

    scoped_series and numbering_restart once a document, at the first such line; a refused start by its reason; gaps in
    the numbers between neighbouring entries with nothing unresolved between them, jumps beyond max_gap; headings in
    doubt; no_records.
    """
    first = lambda rows, code: rows.groupBy("doc").agg(F.min("pos").alias("pos")).select("doc", "pos", F.lit(code).alias("code"), F.lit(None).cast("string").alias("detail"))
    refused = done.where("refused").select("doc", "pos", F.col("why").alias("code"), F.concat_ws(": ", "label", "options").alias("detail"))
    missing = F.col("number") - F.col("last_entry.number") - 1
    gaps = done.where(F.col("opens") & F.col("last_entry").isNotNull() & ~F.coalesce("after_gap", F.lit(False)) & (missing > 0))
    low, high = (F.col("last_entry.number") + 1).cast("string"), (F.col("number") - 1).cast("string")
    gaps = gaps.select("doc", "pos", F.when(missing <= max_gap, "numbering_gap").otherwise("numbering_jump").alias("code"), F.when(missing == 1, low).otherwise(F.concat_ws("-", low, high)).alias("detail"))
    doubt = built.where(F.size("unsure") > 0).join(done.where("opens").select("doc", "block", "pos"), ["doc", "block"]).select("doc", "pos", F.lit("heading_state_uncertain").alias("code"), F.array_join(F.array_sort("unsure"), ", ").alias("detail"))
    empty = done.groupBy("doc").agg(F.max("opens").alias("any")).where("not any").select("doc", F.lit(None).cast("long").alias("pos"), F.lit("no_records").alias("code"), F.lit(None).cast("string").alias("detail"))
    out = first(done.where(_in("series")), "scoped_series").unionByName(first(done.where(_in("candidate") & F.col("restart")), "numbering_restart"))
    for more in (refused, gaps, doubt, empty):
        out = out.unionByName(more)
    return out


def coverage(done: DataFrame) -> DataFrame:
    """One row a document: complete (no unresolved line), lines, entries, unresolved, roles (map), excluded (map by reason)."""
    per = done.groupBy("doc", "role", F.when(F.col("role") == "excluded", F.col("reason")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("opens")).alias("entries"))
    roles = per.groupBy("doc", "role").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries"), F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))).alias("why"))
    sized = lambda c: F.map_from_entries(F.array_sort(c))
    return roles.groupBy("doc").agg(
        (F.sum(F.when(F.col("role") == "unresolved", F.col("n")).otherwise(0)) == 0).alias("complete"), F.sum("n").alias("lines"), F.sum("entries").alias("entries"),
        F.sum(F.when(F.col("role") == "unresolved", F.col("n")).otherwise(0)).alias("unresolved"),
        sized(F.collect_list(F.struct("role", "n"))).alias("roles"), sized(F.flatten(F.collect_list("why"))).alias("excluded"),
    )


def ledger_issues(ledger: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, segment, issue, start, stop): where a ledger's ranges (doc, segment, start, stop) fail to cover the segments
    (doc, segment, text) exactly once. overlap: characters of two ranges; gap: uncovered ones that are not all blank;
    beyond: a range that is empty or leaves its segment; unknown: a range of a segment that there isn't."""
    w = Window.partitionBy("doc", "segment").orderBy("start", "stop")
    sized = ledger.join(texts.select("doc", "segment", "text"), ["doc", "segment"], "left")
    reach = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sized.withColumns({"reach": reach, "last": F.lead("start").over(w).isNull()})
    found = lambda issue, when, a, b: F.when(when, F.struct(F.lit(issue).alias("issue"), a.cast("long").alias("start"), b.cast("long").alias("stop")))
    end = F.greatest("reach", "stop")
    blank = lambda a, b: F.col("text").substr((a + 1).cast("int"), (b - a).cast("int")).rlike(r"^(?U)\s*$")
    length = F.length("text")
    issues = F.array(
        found("unknown", F.col("text").isNull(), F.col("start"), F.col("stop")), found("beyond", (F.col("start") < 0) | (F.col("stop") <= F.col("start")) | (F.col("stop") > length), F.col("start"), F.col("stop")),
        found("overlap", F.col("start") < F.col("reach"), F.col("start"), F.least("stop", "reach")), found("gap", (F.col("start") > F.col("reach")) & ~blank(F.col("reach"), F.col("start")), F.col("reach"), F.col("start")),
        found("gap", F.col("last") & (end < length) & ~blank(end, length), end, length),
    )
    never = texts.join(ledger.select("doc", "segment").distinct(), ["doc", "segment"], "left_anti").where(~F.col("text").rlike(r"^(?U)\s*$")).select("doc", "segment", F.lit("gap").alias("issue"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("stop"))
    return at.select("doc", "segment", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("x")).select("doc", "segment", "x.*").union(never)


def owned_ranges(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, segment, start, stop, kind, region): each region's text, from its start to the next region's, as ranges of
    the lines' segments; neighbouring ranges of a region in one segment are one, blanks at their ends go.

    regions: (doc, region, at_line, at, kind): start by line number and offset. lines: (doc, line, segment, start, stop,
    text): non-blank lines in order, numbered. A line in which regions start is cut there.
    """
    w = Window.partitionBy("doc").orderBy("line", "cut")
    begun = regions.select("doc", F.col("at_line").alias("line"), F.col("at").alias("cut"), "region", "kind")
    pieces = lines.select("doc", "line", F.col("start").alias("cut"), F.lit(None).cast("long").alias("region"), F.lit(None).cast("string").alias("kind")).union(begun.select("doc", "line", "cut", "region", "kind"))
    pieces = pieces.groupBy("doc", "line", "cut").agg(F.max_by("region", "region").alias("region"), F.max_by("kind", "region").alias("kind"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumns({"kind": F.last("kind", True).over(upto), "region": F.last("region", True).over(upto), "next": F.lead("cut").over(Window.partitionBy("doc", "line").orderBy("cut"))})
    cut = pieces.join(lines, ["doc", "line"]).where(F.col("region").isNotNull())
    cut = cut.withColumn("end", F.coalesce("next", "stop")).withColumn("part", F.col("text").substr((F.col("cut") - F.col("start") + 1).cast("int"), (F.col("end") - F.col("cut")).cast("int")))
    lead = F.length("part") - F.length(F.regexp_replace("part", r"^(?U)\s+", ""))
    tail = F.length("part") - F.length(F.regexp_replace("part", r"(?U)\s+$", ""))
    cut = cut.where(~F.col("part").rlike(r"^(?U)\s*$")).select("doc", "line", "region", "kind", "segment", (F.col("cut") + lead).cast("long").alias("start"), (F.col("end") - tail).cast("long").alias("stop"))
    own = Window.partitionBy("doc", "region").orderBy("line", "start")
    runs = cut.withColumn("run", F.count_if(F.coalesce(F.lag("segment").over(own) != F.col("segment"), F.lit(True))).over(own))
    return runs.groupBy("doc", "region", "kind", "run", "segment").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("doc", "segment", "start", "stop", "kind", "region")


def observed_places(replies: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, line, at, kind, label, issue): where a reader's starts stand. replies: (doc, line, kind, label, text), kind
    record or other; lines: (doc, line, start, text).

    A start's text must occur exactly once in its line (any case, any blanks); no text means the line's start. A line
    with an unplaced start is unresolved as a whole and its issue is boundary_unplaced. Starts at one place that say unlike
    kinds are unresolved; unlike labels there are none, and so is one that isn't printed from the place on (label_not_in_source).
    Starts in lines that are not given have no rows.
    """

    @F.pandas_udf("struct<n:int,at:long,printed:boolean>")
    def found(line: pd.Series, text: pd.Series, label: pd.Series) -> pd.DataFrame:
        out = []
        for raw, wanted, name in zip(line, text, label):
            view = View(raw)
            at = [0] if wanted is None or not wanted.strip() else [a for a, _ in places(view, View(wanted).text, bounded=False)]
            printed = len(at) == 1 and name is not None and bool(name.strip()) and next(places(View(raw[at[0] :]), View(name).text, bounded=False), None) is not None
            out.append((len(at), at[0] if at else None, printed))
        return pd.DataFrame(out, columns=["n", "at", "printed"]).astype({"at": "Int64"})

    each = replies.join(lines.select("doc", "line", F.col("start").alias("base"), F.col("text").alias("raw")), ["doc", "line"])
    each = each.withColumn("f", found("raw", "text", "label")).withColumn("bad", F.col("f.n") != 1)
    each = each.withColumn("unplaced", F.max("bad").over(Window.partitionBy("doc", "line")))
    each = each.withColumn("at", F.when(F.col("unplaced"), F.col("base")).otherwise(F.col("base") + F.col("f.at")))
    named = F.when((F.trim("label") != "") & ~F.col("unplaced"), F.col("label"))
    per = each.groupBy("doc", "line", "at").agg(
        F.first("unplaced").alias("unplaced"), F.collect_set("kind").alias("kinds"), F.collect_set(F.when(F.col("f.printed"), named)).alias("labels"),
        F.max(F.coalesce(named.isNotNull() & ~F.col("f.printed"), F.lit(False))).alias("unprinted"),
    )
    kind = F.when(F.col("unplaced") | (F.size("kinds") != 1), "unresolved").otherwise(F.get("kinds", F.lit(0)))
    label = F.when(~F.col("unplaced") & (F.size("labels") == 1), F.get("labels", F.lit(0)))
    return per.select("doc", "line", "at", kind.alias("kind"), label.alias("label"), F.when(F.col("unplaced"), "boundary_unplaced").when(F.col("unprinted"), "label_not_in_source").alias("issue"))


def _routed_lineitems(spark, sf) -> tuple[DataFrame, int]:
    """(lines, tasks). Lines of 32 orders stand for a document; a line's kind, marker and place follow from its columns."""
    k = F.pmod(F.col("l_partkey"), F.lit(29))
    kind = F.when(k < 2, "section").when(k == 2, "heading").when(k == 3, "hint").when(k == 4, "series").when(k == 5, "furniture").when(k == 6, "figure").when(k == 7, "glossary").when(k < 15, "content").otherwise("candidate")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]
    doc = F.floor(F.col("l_orderkey") / 32).cast("long")
    li = T(spark, sf, "lineitem")
    tasks = tasks_for(li)
    rows = li.select(*order, doc.alias("doc")).repartition(tasks, "doc").withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy(*order)).cast("long"))
    lines = lines_of(
        rows, kind=kind, segment=F.concat(F.lit("s"), F.floor((F.col("pos") - 1) / 3)), start=F.pmod(F.col("pos") - 1, F.lit(3)) * 10, stop=F.pmod(F.col("pos") - 1, F.lit(3)) * 10 + 9, number=F.col("l_linenumber"),
        label=F.col("l_linenumber"), restart=F.col("l_suppkey") % 17 == 0, lost=F.col("l_suppkey") % 7 == 0, list_item=F.col("l_suppkey") % 3 == 0, region=F.lit("catalogue"), page=F.floor((F.col("pos") - 1) / 12),
        level=F.lit(1), heading=F.concat(F.lit("h"), F.col("pos")), heading_kind=F.lit("place"),
    )
    return lines, tasks


def segmented_lines(spark, sf):
    """Every line's role, reason and block, with roles of starts that are told by the data instead of resolved."""
    told = F.when(_main(), F.element_at(F.array(*map(F.lit, ("entry", "entry", "list_item", "entry+list_item", "exception"))), (F.pmod(F.col("pos") * 7 + F.col("number"), F.lit(5)) + 1).cast("int")))
    return dispositions(disposed(_routed_lineitems(spark, sf)[0].withColumn("options", told)))


def segmented_blocks(spark, sf):
    """The blocks of the same lines, with the roles of their starts resolved, as text."""
    done = disposed(resolved_starts(*_routed_lineitems(spark, sf)))
    return blocks(done, {"place": 1}).select("doc", "block", "number", "lines", F.to_json("spans").alias("spans"), "continuation", F.array_join("headings", ",").alias("headings"), F.array_join("unsure", ",").alias("unsure"))


def segmentation_coverage(spark, sf):
    return coverage(disposed(resolved_starts(*_routed_lineitems(spark, sf)))).select("doc", "complete", "lines", "entries", "unresolved", F.to_json("roles").alias("roles"))


QUERIES = {f.__name__: f for f in (segmented_lines, segmented_blocks, segmentation_coverage)}
ORACLES = {
    # a walk from line to line that carries the state, where the library uses windows
    "segmented_lines": """WITH RECURSIVE r AS (SELECT *, (l_orderkey // 32) AS doc, l_partkey % 29 AS k, l_suppkey % 17 = 0 AS restart FROM lineitem),
        l AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS pos, l_linenumber AS number, restart, l_suppkey % 7 = 0 AS lost, l_suppkey % 3 = 0 AS item,
            CASE WHEN k < 2 THEN 'section' WHEN k = 2 THEN 'heading' WHEN k = 3 THEN 'hint' WHEN k = 4 THEN 'series' WHEN k = 5 THEN 'furniture' WHEN k = 6 THEN 'figure' WHEN k = 7 THEN 'glossary' WHEN k < 15 THEN 'content' ELSE 'candidate' END AS kind FROM r),
        o AS (SELECT *, kind = 'candidate' AND NOT restart AS main, CASE WHEN kind = 'candidate' AND NOT restart THEN ['entry', 'entry', 'list_item', 'entry+list_item', 'exception'][(pos * 7 + number) % 5 + 1] END AS opt FROM l),
        c AS (SELECT *, count(*) FILTER (main) OVER (PARTITION BY doc, number) AS alike FROM o),
        walk AS (
            SELECT doc, 0::BIGINT AS pos, 0::BIGINT AS n, false AS opened, '' AS state, false AS headed, -1 AS last, '' AS role, NULL::VARCHAR AS reason, NULL::BIGINT AS block FROM (SELECT DISTINCT doc FROM c)
            UNION ALL
            SELECT doc, pos, n + CASE WHEN act = 'open' THEN 1 ELSE 0 END, CASE WHEN act = 'open' THEN true WHEN act = 'stay' THEN opened ELSE false END,
                CASE WHEN act = 'stay' THEN state WHEN act IN ('open', 'stop') THEN '' ELSE why END, CASE WHEN act = 'open' THEN false WHEN act = 'stop' THEN true ELSE headed END,
                CASE WHEN act = 'open' THEN number ELSE last END,
                CASE WHEN kind = 'furniture' THEN 'excluded' WHEN kind IN ('section', 'heading') THEN 'heading' WHEN kind IN ('figure', 'glossary') THEN kind WHEN act = 'open' OR (act = 'stay' AND opened AND kind IN ('candidate', 'content')) THEN 'entry' ELSE 'unresolved' END,
                CASE WHEN kind = 'furniture' THEN 'furniture' WHEN kind = 'section' THEN 'catalogue' WHEN kind = 'hint' THEN 'unclassified_heading' WHEN act = 'refuse' THEN why
                    WHEN kind = 'content' AND NOT opened THEN CASE WHEN state <> '' THEN state WHEN item THEN 'unnumbered_item' WHEN headed THEN 'orphan_after_heading' ELSE 'orphan_before_first_entry' END END,
                CASE WHEN act = 'open' THEN n + 1 WHEN act = 'stay' AND opened AND kind IN ('candidate', 'content') THEN n END
            FROM (SELECT c.*, w.n, w.opened, w.state, w.headed, w.last,
                    CASE WHEN kind IN ('section', 'heading', 'hint') THEN 'stop' WHEN opt = 'entry' THEN 'open' WHEN opt = 'list_item' AND opened THEN 'stay' WHEN kind IN ('series', 'candidate') OR (kind = 'content' AND opened AND lost) THEN 'refuse' ELSE 'stay' END AS act,
                    CASE WHEN kind = 'series' OR NOT main AND kind = 'candidate' THEN 'scoped_identity_unsupported' WHEN kind = 'content' THEN 'unnumbered_item' WHEN contains(opt, '+') THEN 'ambiguous_start'
                        WHEN last = number THEN 'duplicate_identity' WHEN last > number THEN 'backward_label' ELSE 'sequence_exception' END AS why
                FROM walk w JOIN c ON c.doc = w.doc AND c.pos = w.pos + 1))
        SELECT doc, pos, 's' || ((pos - 1) // 3) AS segment, (pos - 1) % 3 * 10 AS start, (pos - 1) % 3 * 10 + 9 AS stop, role, reason, block FROM walk WHERE pos > 0""",
}
