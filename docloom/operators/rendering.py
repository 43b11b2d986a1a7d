"""Documents as text: Markdown with the bytes of every block, and tagged source that gives back what it wraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import read_table as T


def markdown_spans(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks (doc, page, nth, text) with start and stop: the UTF-8 bytes of each block in the document's Markdown, where
    blocks follow each other in order of page and nth with a blank line between. Null texts are empty blocks."""
    w = Window.partitionBy(doc).orderBy("page", "nth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    start = F.coalesce(F.sum(size + 2).over(w), F.lit(0)).cast("long")
    return blocks.withColumn("start", start).withColumn("stop", (start + size).cast("long"))


def page_spans(spans: DataFrame, doc: str) -> DataFrame:
    """(doc, page, start, stop): the bytes of each page that has blocks."""
    return spans.groupBy(doc, "page").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def markdown(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, markdown): the text that the spans are places in; it ends with a line end unless it is empty. A document is
    put together in one task, as the text is one value."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "nth", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    whole = blocks.groupBy(doc).agg(F.array_join(listed, "\n\n").alias("markdown"))
    return whole.withColumn("markdown", F.when(F.col("markdown") == "", "").otherwise(F.concat("markdown", F.lit("\n"))))


def escaped_text(c: Column, quotes: bool = False) -> Column:
    """The text with the characters that markup uses as references; quotes too inside attributes."""
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else out


def tagged_source(passages: DataFrame, cells: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, issues): blocks (doc, segment, place, block), each passage (doc, segment, place, label, page, text, rows,
    columns) wrapped in tags; tables (rows not null) with a tag around every cell (doc, segment, cell, row, column,
    rowspan, colspan, role, start, stop, text), the text between cells kept. Without the tags and with references
    resolved a block is the passage's text. issues (doc, segment, cell): cells that overlap, or whose text isn't what
    stands at their place; their passages have no block."""
    by = [doc, "segment"]
    w = Window.partitionBy(*by).orderBy("start", "stop", "cell").rowsBetween(Window.unboundedPreceding, -1)
    told = cells.withColumnRenamed("text", "cell_text").join(passages.where("rows IS NOT NULL").select(*by, "text"), by).withColumn("cursor", F.coalesce(F.max("stop").over(w), F.lit(0)))
    part = lambda a, b: F.col("text").substr((a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    bad = (F.col("start") < F.col("cursor")) | (F.col("stop") > F.length("text")) | ~part(F.col("start"), F.col("stop")).eqNullSafe(F.coalesce("cell_text", F.lit("")))
    told = told.withColumn("bad", F.coalesce(bad, F.lit(True)))
    number = lambda n: F.concat(F.lit(f' {n}="'), F.col(n).cast("string"), F.lit('"'))
    role = F.when(F.col("role").isNotNull(), F.concat(F.lit(' role="'), escaped_text(F.col("role"), True), F.lit('"'))).otherwise("")
    tag = F.concat(F.lit('<cell id="'), escaped_text(F.col("cell").cast("string"), True), F.lit('"'), *map(number, ("row", "column", "rowspan", "colspan")), role, F.lit(">"), escaped_text(F.coalesce("cell_text", F.lit(""))), F.lit("</cell>"))
    pieces = told.select(*by, "bad", "start", "stop", "cell", F.concat(escaped_text(part(F.col("cursor"), F.col("start"))), tag).alias("piece"))
    joined = pieces.groupBy(*by).agg(F.max("bad").alias("bad"), F.max("stop").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "stop", "cell", "piece"))), lambda x: x["piece"]), "").alias("inner"))
    both = passages.join(joined, by, "left").where("bad IS NULL OR NOT bad")
    opening = F.concat(F.lit('<block id="'), escaped_text(F.col("segment"), True), F.lit('" label="'), escaped_text(F.coalesce("label", F.lit("")), True), F.lit('" page="'), F.col("page").cast("string"), F.lit('">'))
    text = F.coalesce("text", F.lit(""))
    rest = escaped_text(text.substr((F.coalesce("last", F.lit(0)) + 1).cast("int"), F.greatest(F.length(text) - F.coalesce("last", F.lit(0)), F.lit(0)).cast("int")))
    table = F.concat(F.lit('<table rows="'), F.col("rows").cast("string"), F.lit('" columns="'), F.col("columns").cast("string"), F.lit('">'), F.coalesce("inner", F.lit("")), rest, F.lit("</table>"))
    block = F.concat(opening, F.when(F.col("rows").isNotNull(), table).otherwise(escaped_text(text)), F.lit("</block>"))
    return both.select(*by, "place", block.alias("block")), told.where("bad").select(*by, "cell")


def merged_contributions(values: DataFrame, keys: list[str], seq: str, kind: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): contributions (keys, seq, kind, value as an array of text) to each value, earlier ones first.

    A scalar (an array of one) keeps its earliest value, and each later one that differs is a conflict (keys, seq, kept,
    proposed). A list gets the later items after its own, unless a contribution equals all that is there. Null
    contributions change nothing; what has nothing else is null.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(value).alias("v"))))), lambda x: x["v"])
    per = values.groupBy(*keys).agg(F.first(kind).alias("kind"), ordered.alias("all"))
    nothing = F.array().cast("array<string>")
    listed = F.aggregate("all", nothing, lambda acc, x: F.when(acc == x, acc).otherwise(F.concat(acc, x)))
    merged = per.select(*keys, F.when(F.size("all") == 0, F.lit(None)).when(F.col("kind") == "array", listed).otherwise(F.get("all", F.lit(0))).alias("value"))
    first = per.where("kind <> 'array'").select(*(F.col(k).alias(f"__{k}") for k in keys), F.get("all", F.lit(0)).alias("kept"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    conflicts = values.where(F.col(value).isNotNull()).join(first, on).where(F.col(value) != F.col("kept")).select(*keys, seq, "kept", F.col(value).alias("proposed"))
    return merged, conflicts


def _turn_blocks(spark, sf) -> DataFrame:
    """Conversations as documents of three turns a page."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return T(spark, sf, "conversations").select("conv_id", "text", nth.alias("i")).select("conv_id", F.floor((F.col("i") - 1) / 3).cast("int").alias("page"), F.col("i").alias("nth"), "text")


def markdown_of_turns(spark, sf):
    """The bytes of every turn, and a digest of what stands there."""
    spans = markdown_spans(_turn_blocks(spark, sf), "conv_id")
    whole = markdown(_turn_blocks(spark, sf), "conv_id").select("conv_id", F.encode("markdown", "utf-8").alias("m"))
    cut = F.substring(F.col("m"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return spans.join(whole, "conv_id").select("conv_id", "nth", "start", "stop", F.sha2(cut, 256).alias("sha256"))


def tagged_turns(spark, sf):
    """Turns as tagged blocks; every fourth is a table of two cells, its first three characters and the last."""
    b = _turn_blocks(spark, sf).where("text IS NOT NULL")
    table = (F.col("nth") % 4 == 0) & (F.length("text") >= 5)
    two = F.when(table, F.lit(2))
    p = b.select("conv_id", F.concat(F.lit("s"), "nth").alias("segment"), F.col("nth").alias("place"), F.lit('a "b"').alias("label"), "page", "text", F.when(table, 1).alias("rows"), two.alias("columns"))
    cell = lambda i, a, z: F.struct(F.lit(f"c{i}").alias("cell"), F.lit(0).alias("row"), F.lit(i).alias("column"), a.alias("start"), z.alias("stop"))
    cells = p.where("rows IS NOT NULL").select("conv_id", "segment", "text", F.explode(F.array(cell(0, F.lit(0), F.lit(3)), cell(1, F.length("text") - 1, F.length("text")))).alias("c"))
    cells = cells.select("conv_id", "segment", "c.*", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(None).cast("string").alias("role"), F.col("text").substr(F.col("c.start") + 1, F.col("c.stop") - F.col("c.start")).alias("text"))
    return tagged_source(p, cells, "conv_id")[0].select("conv_id", "segment", F.sha2("block", 256).alias("sha256"))


def merged_statuses(spark, sf):
    """Customers' orders as contributions: the first priority stays, statuses are lists joined one after the other."""
    o = T(spark, sf, "orders").select("o_custkey", "o_orderkey", F.explode(F.array(F.struct(F.lit("scalar").alias("kind"), F.when(F.col("o_orderkey") % 5 != 0, F.array("o_orderpriority")).alias("v")), F.struct(F.lit("array").alias("kind"), F.array("o_orderstatus").alias("v")))).alias("x")).select("o_custkey", "o_orderkey", "x.*")
    merged, conflicts = merged_contributions(o.withColumn("path", F.col("kind")), ["o_custkey", "path"], "o_orderkey", "kind", "v")
    n = conflicts.groupBy("o_custkey", "path").agg(F.count("*").alias("conflicts"))
    return merged.join(n, ["o_custkey", "path"], "left").select("o_custkey", "path", F.array_join("value", ",").alias("value"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


QUERIES = {f.__name__: f for f in (markdown_of_turns, tagged_turns, merged_statuses)}
_E = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLES = {
    "markdown_of_turns": """WITH b AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth FROM conversations),
        s AS (SELECT *, coalesce(sum(strlen(text) + 2) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM b)
        SELECT conv_id, nth, start, start + strlen(text) AS stop, sha256(text) AS sha256 FROM s""",
    "tagged_turns": f"""WITH b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth FROM conversations),
        t AS (SELECT *, 'c' AS c, '<block id="s' || nth || '" label="a &quot;b&quot;" page="' || ((nth - 1) // 3) || '">' AS head FROM b WHERE text IS NOT NULL)
        SELECT conv_id, 's' || nth AS segment, sha256(head || CASE WHEN nth % 4 = 0 AND length(text) >= 5 THEN '<table rows="1" columns="2"><cell id="c0" row="0" column="0" rowspan="1" colspan="1">' || {_E.format('text[1:3]')} || '</cell>' || {_E.format('text[4:length(text) - 1]')}
            || '<cell id="c1" row="0" column="1" rowspan="1" colspan="1">' || {_E.format('text[length(text):]')} || '</cell></table>' ELSE {_E.format('text')} END || '</block>') AS sha256 FROM t""",
    # a list whose next part equals all it has stays: with parts of one status, only where that status alone is there
    "merged_statuses": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 5 <> 0 AS given FROM orders),
        f AS (SELECT o_custkey, arg_min(p, o_orderkey) FILTER (given) AS p FROM o GROUP BY 1),
        n AS (SELECT o.o_custkey, f.p, count(*) FILTER (given AND o.p <> f.p) AS c FROM o JOIN f USING (o_custkey) GROUP BY ALL),
        w AS (SELECT *, s = first_value(s) OVER c AND min(CASE WHEN s <> q THEN 0 ELSE 1 END) OVER c = 1 AND row_number() OVER c > 1 AS again FROM (SELECT *, first_value(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM o) WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT o_custkey, 'scalar' AS path, p AS value, c AS conflicts FROM n UNION ALL SELECT o_custkey, 'array', string_agg(s, ',' ORDER BY o_orderkey) FILTER (NOT again), 0 FROM w GROUP BY 1""",
}
