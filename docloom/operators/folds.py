"""Work that has to go through a group's rows in order: cutting, packing and resolving starts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.lines import text_lines
from docloom.sources.tables import read_table as T

#: The longest start of a text that ends with a sentence and its spaces, or with a space.
_SENTENCE, _SPACE = re.compile(r"(?s).*[.!?。！？]\s+"), re.compile(r"(?s).*\s")
#: What a passage costs besides its text. Fixed value.
PASSAGE_COST = 12


def fold_in_order(df: DataFrame, group: list[str], order: list[str], start: Callable, schema: str, tasks: int | None = None) -> DataFrame:
    """Rows of each group go, in order, to the feed that start(group values) returns; a feed takes a row and returns
    rows of output, and takes None at the group's end. Groups stream through a task, so none is held as a whole. tasks: how
    many they are dealt to, else the session's number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        current, feed = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                values = tuple(getattr(row, g) for g in group)
                if feed is None or values != current:
                    out += feed(None) if feed is not None else []
                    current, feed = values, start(values)
                out += feed(row)
            yield pd.DataFrame(out, columns=names)
        if feed is not None:
            yield pd.DataFrame(feed(None), columns=names)

    return (df.repartition(tasks, *group) if tasks else df.repartition(*group)).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def sentence_ranges(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Spans of at most `most` code points that cover the text once. A span ends after a sentence, else after a space,
    in its second half if there is one."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            ends = (m.end() for pattern, least in ((_SENTENCE, most // 2), (_SPACE, most // 2 + 1)) if (m := pattern.match(text, at, end)) and m.end() - at >= least)
            end = next(ends, end)
        yield at, min(end, len(text))
        at = end


def sentence_spans(docs: DataFrame, most: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end). Null and empty texts have no spans."""

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in sentence_ranges(t or "", most)])

    return docs.where(F.col(text).isNotNull()).select(key, F.explode(cut(text)).alias("s")).select(key, "s.start", "s.end")


def sentence_aware_spans(spark, sf):
    return sentence_spans(T(spark, sf, "documents"))


def packed_chunks(units: DataFrame, group: str, order: str, cost: str, most: int) -> DataFrame:
    """(group, order, chunk): units in order, as many to a chunk as its budget holds; a unit above it stands alone."""

    def start(values):
        used, chunk = 0, 0

        def feed(row):
            nonlocal used, chunk
            if row is None:
                return []
            size = getattr(row, cost)
            if chunk == 0 or used + size > most:
                chunk, used = chunk + 1, 0
            used += size
            return [(values[0], getattr(row, order), chunk)]

        return feed

    return fold_in_order(units.select(group, order, cost), [group], [order], start, f"{group} bigint, {order} bigint, chunk bigint")


def packed_turns(spark, sf):
    units = T(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") + PASSAGE_COST).cast("bigint").alias("cost"))
    return packed_chunks(units, "conv_id", "turn", "cost", 600)


def cut_unit(text: str, most: int) -> list[tuple[int, int]]:
    """A unit in pieces of at most `most` code points; but for the last, a piece ends before its last space, if it has one."""
    piece = rf"(?s)\s*(.{{1,{most}}}\Z|.{{1,{max(most - 1, 1)}}}(?= )|.{{1,{most}}})"
    return [m.span(1) for m in re.finditer(piece, text)]


def greedy_windows(units: DataFrame, key: str, start: str, end: str, most: int, overlap: bool) -> DataFrame:
    """(key, window, start, end) over the pieces of a text in order. With overlap, a window begins with the last piece
    of the one before, if both fit. The state is one window's pieces."""

    def begin(values):
        window: list[tuple[int, int]] = []
        number, shared = 1, False

        def feed(row):
            nonlocal window, number, shared
            piece = None if row is None else (getattr(row, start), getattr(row, end))
            size = sum(b - a for a, b in window)
            if piece is not None and (not window or size + piece[1] - piece[0] <= most):
                window.append(piece)
                shared = False
                return []
            out = [] if shared or not window else [(values[0], number, a, b) for a, b in window]
            if piece is not None:
                last = window[-1]
                again = overlap and len(window) > 1 and (last[1] - last[0]) + (piece[1] - piece[0]) <= most
                window, number = ([last] if again else []) + [piece], number + 1
            return out

        return feed

    return fold_in_order(units.select(key, start, end), [key], [start, end], begin, f"{key} bigint, window bigint, {start} bigint, {end} bigint")


def line_pieces(docs: DataFrame, most: int) -> DataFrame:
    """The lines of documents; one above the budget is cut."""
    lines = text_lines(docs).select("doc_id", "line", "line_start")

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"a": a, "b": b} for a, b in cut_unit(t, most)])

    return lines.select("doc_id", "line_start", F.explode(cut("line")).alias("p")).select("doc_id", (F.col("line_start") + F.col("p.a")).alias("start"), (F.col("line_start") + F.col("p.b")).alias("end"))


def overlapping_line_windows(spark, sf):
    return greedy_windows(line_pieces(T(spark, sf, "documents"), 400), "doc_id", "start", "end", 400, True)


def start_roles(numbers: list[int], suffixes: list[str], barriers: list[bool], inline: list[list[int]] | None = None) -> list[str]:
    """The role of each numbered start: entry if it goes on from the last entry, list_item if it goes on in the open
    entry's list, exception otherwise, with the fewest exceptions; roles that occur in some best reading are joined.
    inline: the numbers written inside lines since the start before; in an open entry they begin or go on its list."""
    states = [{(None, False, 0): 0}]
    moves = []
    for n, s, wall, written in zip(numbers, suffixes, barriers, inline or [()] * len(numbers)):
        costs, step = {}, []
        for state, cost in states[-1].items():
            last, opened, length = state
            if wall:
                opened, length = False, 0
            for x in written if opened else ():
                length = x if x in (1, length + 1) else length
            options = [("exception", (last, False, 0), 1)]
            if last is None or (n, s) > last:
                options.append(("entry", ((n, s), True, 0), 0))
            if opened and not s and n in (1, length + 1):
                options.append(("list_item", (last, True, n), 0))
            for role, to, more in options:
                step.append((state, role, to, more))
                costs[to] = min(costs.get(to, cost + more), cost + more)
        states.append(costs)
        moves.append(step)
    best = min(states[-1].values())
    live = {s for s, c in states[-1].items() if c == best}
    out = []
    for before, step, after in zip(states[-2::-1], moves[::-1], states[:0:-1]):
        used = [(a, role) for a, role, to, more in step if to in live and before[a] + more == after[to]]
        out.append("+".join(sorted({role for _, role in used})))
        live = {a for a, _ in used}
    return out[::-1]


def entry_starts_min_exceptions(spark, sf):
    """Lines of an order as a document's numbered starts; a return is a barrier. Both directions need a document's starts, so those of
    one document at a time are held."""

    def begin(values):
        seen = []

        def feed(row):
            if row is not None:
                seen.append((row.position, row.number, row.barrier))
                return []
            roles = start_roles([n for _, n, _ in seen], [""] * len(seen), [b for *_, b in seen])
            return [(values[0], p, role) for (p, *_), role in zip(seen, roles)]

        return feed

    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    starts = T(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(w).cast("bigint").alias("position"), F.col("l_linenumber").alias("number"), (F.col("l_returnflag") == "R").alias("barrier"))
    return fold_in_order(starts, ["l_orderkey"], ["position"], begin, "l_orderkey bigint, position bigint, role string")


QUERIES = {f.__name__: f for f in (sentence_aware_spans, packed_turns, overlapping_line_windows, entry_starts_min_exceptions)}
ORACLES = {
    "packed_turns": f"""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) + {PASSAGE_COST} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
        p AS (SELECT conv_id, turn, i, cost AS used, 1::BIGINT AS chunk FROM t WHERE i = 1 UNION ALL
        SELECT t.conv_id, t.turn, t.i, CASE WHEN used + cost > 600 THEN cost ELSE used + cost END, chunk + CASE WHEN used + cost > 600 THEN 1 ELSE 0 END FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i + 1)
        SELECT conv_id, turn, chunk FROM p""",
}
