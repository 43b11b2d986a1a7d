"""Ranking passages, and ordered reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import guard_formula, occurrences, safe_filename, words
from docloom.sources.tables import read_table as T

#: BM25's constants. Fixed values.
K1, B = 1.2, 0.75


def bm25(passages: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score) of passages with any of the terms. Only query terms are counted, so what is shuffled is a row a
    (passage, query term); lengths and frequencies are plain aggregates."""
    p = passages.select(key, words(F.col(text)).alias("w"))
    hits = F.filter("w", lambda x: x.isin(terms))
    stats = p.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg"))
    tf = p.select(key, F.size("w").alias("len"), F.explode(hits).alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    # the frequencies have a row a query term and the statistics one row
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).withColumn("s", weight)
    return scored.groupBy(key).agg(F.round(F.sum("s"), 7).alias("score"))


def bm25_rank(spark, sf):
    c = T(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return bm25(c, "k", "text", ["the", "and", "der", "que"]).select("k.conv_id", "k.turn", "score")


def bounded_occurrences(spark, sf):
    """Whole-word places of a few terms in every document."""
    terms = F.explode(F.array(*map(F.lit, ["the", "der", "que", "la"]))).alias("term")
    d = T(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"), terms)
    return d.withColumn("n", occurrences(F.col("t"), F.col("term")).cast("bigint")).where("n > 0").select("doc_id", "term", "n")


def neighbour_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = lambda c: F.length(c).cast("bigint")
    return T(spark, sf, "conversations").select("conv_id", "turn", text(F.lag("text").over(w)).alias("before_chars"), text(F.lead("text").over(w)).alias("after_chars"), F.lag("role").over(w).alias("before_role"))


def sticky_role_region(spark, sf):
    """Turns take the last system turn before them as their region."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return T(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "system", F.col("turn")), True).over(w).alias("region"))


def heading_state(spark, sf):
    """A heading of level 1 (system) clears that of level 2 (user) under it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = T(spark, sf, "conversations").select("conv_id", "turn", "role").withColumn("top", F.count_if(F.col("role") == "system").over(w))
    under = Window.partitionBy("conv_id", "top").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    h1 = F.last(F.when(F.col("role") == "system", F.col("turn")), True).over(w)
    h2 = F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(under)
    return c.select("conv_id", "turn", h1.alias("level1"), h2.alias("level2"))


def numbering_gaps(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    gap = F.col("l_linenumber") - F.lag("l_linenumber").over(w)
    return T(spark, sf, "lineitem").withColumn("gap", gap).where("gap > 1").groupBy("l_orderkey").agg(F.count("*").alias("gaps"), F.max("gap").alias("widest"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n rows a stratum (fewer, if it has fewer), those with the smallest digests of their keys: the same on every run."""
    h = F.md5(F.col(key).cast("string"))
    w = Window.partitionBy(stratum).orderBy(h, key)
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def stratified_documents(spark, sf):
    return stratified_sample(T(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


def recent_activity_feed(spark, sf):
    """The newest 50 of two kinds of activity, ties by kind and id; a top-k, so no full sort."""
    o = T(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"))
    e = T(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return o.union(e).orderBy(F.desc("at_us"), "kind", F.desc("id")).limit(50)


def offset_page(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


def formula_guard(spark, sf):
    signed = F.concat(F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "x"])), (F.col("p_partkey") % 5 + 1).cast("int")), "p_name")
    return T(spark, sf, "part").select("p_partkey", guard_formula(signed).alias("cell"))


def safe_filenames(spark, sf):
    return T(spark, sf, "supplier").select("s_suppkey", F.concat(safe_filename(F.concat_ws(" / ", "s_name", F.col("s_nationkey").cast("string"))), F.lit(".csv")).alias("file_name"))


QUERIES = {f.__name__: f for f in (bm25_rank, bounded_occurrences, neighbour_context, sticky_role_region, heading_state, numbering_gaps, stratified_documents, recent_activity_feed, offset_page, formula_guard, safe_filenames)}
_W = "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
ORACLES = {
    "bm25_rank": r"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM conversations), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM p),
        tf AS (SELECT conv_id, turn, l, term, count(*) AS tf FROM (SELECT conv_id, turn, len(w) AS l, unnest(w) AS term FROM p) WHERE term IN ('the', 'and', 'der', 'que') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
        SELECT conv_id, turn, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 7) AS score FROM tf JOIN df USING (term), st GROUP BY 1, 2""",
    "bounded_occurrences": r"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) WHERE term IN ('the', 'der', 'que', 'la') GROUP BY ALL",
    "neighbour_context": f"SELECT conv_id, turn, length(lag(text) OVER w) AS before_chars, length(lead(text) OVER w) AS after_chars, lag(role) OVER w AS before_role FROM conversations {_W}",
    "sticky_role_region": f"SELECT conv_id, turn, max(CASE WHEN role = 'system' THEN turn END) OVER w AS region FROM conversations {_W}",
    "heading_state": f"WITH c AS (SELECT *, count(*) FILTER (role = 'system') OVER w AS top FROM conversations {_W}) SELECT conv_id, turn, max(CASE WHEN role = 'system' THEN turn END) OVER w AS level1, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id, top ORDER BY turn) AS level2 FROM c {_W}",
    "numbering_gaps": "SELECT l_orderkey, count(*) AS gaps, max(gap) AS widest FROM (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS gap FROM lineitem) WHERE gap > 1 GROUP BY 1",
    "stratified_documents": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 20",
    "recent_activity_feed": "SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, epoch_us(o_orderdate) AS at_us FROM orders UNION ALL SELECT 'event', event_id, epoch_us(ts) FROM events) ORDER BY at_us DESC, kind, id DESC LIMIT 50",
    "offset_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "formula_guard": "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN '''' ELSE '' END || (['=', '+', '-', '@', 'x'])[p_partkey % 5 + 1] || p_name AS cell FROM part",
    "safe_filenames": "SELECT s_suppkey, regexp_replace(s_name || ' / ' || s_nationkey, '[^A-Za-z0-9._-]+', '_', 'g') || '.csv' AS file_name FROM supplier",
}
