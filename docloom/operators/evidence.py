"""Finding, routing and selecting the text that supports a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import words
from docloom.operators.lines import text_lines
from docloom.sources.tables import read_table as T

#: Rules for lines, first match wins; patterns that Java and RE2 read alike. Fixed values.
RULES = [("numbered", r"^[0-9]+[.)] "), ("bullet", r"^[-*•] "), ("link", r"https?://"), ("heading", r"^[^.!?,;:]{1,40}$"), ("terms", r"(?i)(license|copyright|all rights reserved)")]


def routed(lines: DataFrame, text: str, rules: list[tuple[str, str]] = RULES, other: str = "content") -> DataFrame:
    """Adds kind: the first rule that a line fits."""
    kind: Column = F.lit(other)
    for name, pattern in reversed(rules):
        kind = F.when(F.col(text).rlike(pattern), name).otherwise(kind)
    return lines.withColumn("kind", kind)


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_start, line): the lines of texts."""
    return text_lines(docs).select("doc_id", "line_start", "line")


def routed_line_kinds(spark, sf):
    """Kinds of lines, with the start of the last heading before or at each as its region."""
    lines = routed(document_lines(T(spark, sf, "documents")), "line").drop("line")
    w = Window.partitionBy("doc_id").orderBy("line_start").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("region", F.last(F.when(F.col("kind") == "heading", F.col("line_start")), True).over(w))


def containment(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text") -> DataFrame:
    """(doc, item): items whose words stand consecutively in a document. Both meet on the item's first two words, so
    only likely pairs are compared; items of fewer words take no part."""
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    d = docs.select(doc, words(F.col(text)).alias("w"))
    pairs = F.array_distinct(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    keys = d.where(F.size("w") > 1).select(doc, F.explode(pairs).alias("start"))
    i = items.select(item, words(F.col(text)).alias("w")).where(F.size("w") > 1)
    i = i.select(item, F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("start"), spaced(F.col("w")).alias("phrase"))
    likely = keys.join(i, "start").select(doc, item, "phrase")
    return likely.join(d.select(doc, spaced(F.col("w")).alias("t")), doc).where(F.contains("t", "phrase")).select(doc, item).distinct()


def benchmark_containment(spark, sf):
    return containment(T(spark, sf, "documents"), T(spark, sf, "benchmark"), "doc_id", "item_id")


def select_contexts(passages: DataFrame, group: str, order: str, text: str, support: Column, terms: list[str]) -> DataFrame:
    """(group, order, why) of passages to read: the supporting ones, their neighbours, and the best of the others by
    tf·idf within the group, if it scores above zero; ties go to the first."""
    w = Window.partitionBy(group).orderBy(order)
    p = passages.select(group, order, words(F.col(text)).alias("__w"), support.alias("__s"))
    beside = F.coalesce(F.lag("__s").over(w), F.lit(False)) | F.coalesce(F.lead("__s").over(w), F.lit(False))
    whole = Window.partitionBy(group)
    p = p.withColumns({f"__tf{i}": F.size("__w") - F.size(F.array_remove("__w", t)) for i, t in enumerate(terms)} | {"__beside": beside, "__n": F.count("*").over(whole)})
    p = p.withColumns({f"__df{i}": F.count_if(F.col(f"__tf{i}") > 0).over(whole) for i in range(len(terms))})
    score = sum((F.when(F.col(f"__tf{i}") > 0, (1 + F.log(f"__tf{i}")) * F.log((F.col("__n") + 1) / (F.col(f"__df{i}") + 1)) / F.sqrt(F.size("__w"))).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    p = p.withColumn("__score", F.round(score, 9))
    free = F.when(~F.col("__s") & ~F.col("__beside") & (F.col("__score") > 0), F.struct("__score", (-F.col(order)).alias("o")))
    best = F.max(free).over(whole)
    why = F.when(F.col("__s"), "support").when(F.col("__beside"), "neighbour").when(free == best, "retrieved")
    return p.withColumn("why", why).where("why is not null").select(group, order, "why")


def context_selection(spark, sf):
    return select_contexts(T(spark, sf, "conversations"), "conv_id", "turn", "text", F.col("turn") == 0, ["the", "and", "der", "und", "que", "la"])


def values_after(text: Column, keys: list[str], value: str, gap: int = 3) -> Column:
    """Array of what matches `value` (a pattern without groups) at most `gap` characters that are no letters or digits
    behind one of the keys, in order; a key may be any text, in any case."""
    listed = "|".join(r"\Q" + k.replace(r"\E", r"\E\\E\Q") + r"\E" for k in sorted(keys, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"(?iu:{listed})[^\p{{L}}\p{{N}}]{{0,{gap}}}({value})"), F.lit(1))


def values_after_keys(spark, sf):
    """Numbers behind the key k of an event's properties."""
    return T(spark, sf, "events").select("event_id", F.explode(values_after(F.col("props"), ["k"], "[0-9]+")).alias("value"))


def quote(text: Column, term: str, around: int) -> Column:
    """The first place of a term, whatever its case, with so many characters on each side; null if there is none."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.translate(F.substring(text, start, at - start + len(term) + around), "\n", " "))


def evidence_quotes(spark, sf):
    return T(spark, sf, "conversations").select("conv_id", "turn", quote(F.col("text"), "que", 20).alias("quote")).where("quote is not null")


def unfenced(reply: Column) -> Column:
    """A model's reply without one leading block of thoughts and one code fence."""
    no_thought = F.regexp_replace(reply, r"(?s)^\s*<think>.*?</think>", "")
    return F.regexp_replace(no_thought, r"(?s)^\s*```[a-z]*\n(.*?)\n?```\s*$", "$1")


def fenced_json(spark, sf):
    """Replies made of the events' properties, fenced or with thoughts before; then the value of k."""
    p, i = F.col("props"), F.col("event_id") % 3
    reply = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).otherwise(F.concat(F.lit("<think>so\n</think>```\n"), p, F.lit("\n```")))
    return T(spark, sf, "events").select("event_id", F.get_json_object(unfenced(reply), "$.k").alias("k"))


def printed_forms(value: Column) -> Column:
    """How a number may be printed: an integer as it is, else with a point and with a comma, never with an exponent."""
    plain = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    return F.when(value == F.floor(value), F.array(value.cast("bigint").cast("string"))).otherwise(F.array(plain, F.translate(plain, ".", ",")))


def printed_prices(spark, sf):
    v = F.round(F.col("l_extendedprice"), 1)
    return T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(printed_forms(v)).alias("form"))


def mask(text: Column, ranges: Column) -> Column:
    """The text with the half-open ranges (start, end) blanked, so that other offsets stay; what lies beyond its end is none."""
    ranges = F.transform(F.filter(ranges, lambda r: r["start"] < F.length(text)), lambda r: F.struct(r["start"].alias("start"), F.least(r["end"], F.length(text)).alias("end")))
    length = lambda r: (r["end"] - r["start"]).cast("int")
    return F.aggregate(ranges, text, lambda t, r: F.overlay(t, F.repeat(F.lit(" "), length(r)), (r["start"] + 1).cast("int"), length(r)))


def masked_turns(spark, sf):
    """Turns without the part that earlier work covered, their first ten characters and five more; those that have nothing
    else go."""
    c = T(spark, sf, "conversations")
    ranges = F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("end")), F.struct(F.lit(12).alias("start"), F.lit(17).alias("end")))
    return c.select("conv_id", "turn", mask(F.col("text"), ranges).alias("rest")).where(F.regexp_replace("rest", r"\s", "") != "")


def allowed(df: DataFrame, value: str, listed: DataFrame, name: str) -> DataFrame:
    """df with each value as the list writes it, if it is there but for case and outer spaces; others stay as they are."""
    names = listed.select(F.lower(F.trim(F.col(name))).alias("__k"), F.col(name).alias("__v")).groupBy("__k").agg(F.min("__v").alias("__v"))
    return df.withColumn("__k", F.lower(F.trim(F.col(value)))).join(names, "__k", "left").withColumn(value, F.coalesce("__v", value)).drop("__k", "__v")


def allowed_values(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.lower("p_type"))).otherwise(F.concat("p_type", F.lit("?"))).alias("kind"))
    return allowed(p, "kind", T(spark, sf, "part").select("p_type").distinct(), "p_type")


def exported_values(df: DataFrame, saved: Column, action: Column, edit: Column, model: Column) -> DataFrame:
    """df, without the values that weren't saved, and what is exported of each as `value`: the edit of an edited one,
    nothing of a rejected one, else the model's; `state` names which: EDITED, REJECTED, APPROVED, or MODEL without a decision."""
    value = F.when(action == "EDITED", edit).when(action == "REJECTED", F.lit(None)).otherwise(model)
    state = F.when(action.isin("EDITED", "REJECTED", "APPROVED"), action).otherwise("MODEL")
    return df.where(F.coalesce(saved, F.lit(False))).withColumns({"value": value, "state": state})


def in_review(df: DataFrame, wanted: str | None, state: str = "state") -> DataFrame:
    """The rows of one state of review; all without one."""
    return df if wanted is None else df.where(F.col(state) == wanted)


def reviewed_values(spark, sf):
    """Orders' priorities as values: pending orders edited them, fulfilled ones rejected them."""
    s = F.col("o_orderstatus")
    action = F.when(s == "P", "EDITED").when(s == "F", "REJECTED")
    return exported_values(T(spark, sf, "orders"), F.lit(True), action, F.upper("o_orderpriority"), F.col("o_orderpriority")).select("o_orderkey", "value", "state")


def work_order(spark, sf):
    """Each conversation's turns by distance from turn 2, then in source order."""
    w = Window.partitionBy("conv_id").orderBy(F.abs(F.col("turn") - 2).asc_nulls_last(), "turn")
    return T(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("place"))


def block_context(spark, sf):
    """Of each turn, the two before and the one after, joined by blank lines, as a digest."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    join = lambda frame: F.sha2(F.array_join(F.collect_list(F.trim("text")).over(frame), "\n\n"), 256)
    return T(spark, sf, "conversations").select("conv_id", "turn", join(w.rowsBetween(-2, -1)).alias("before_sha"), join(w.rowsBetween(1, 1)).alias("after_sha"))


QUERIES = {f.__name__: f for f in (routed_line_kinds, benchmark_containment, context_selection, values_after_keys, evidence_quotes, fenced_json, printed_prices, masked_turns, allowed_values, reviewed_values, work_order, block_context)}
_LINES = r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s),
    l AS (SELECT doc_id, (pos + length(line) - length(ltrim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))))::BIGINT AS line_start, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM o WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '')"""
_TERMS = ["the", "and", "der", "und", "que", "la"]
ORACLES = {
    "routed_line_kinds": _LINES + ", k AS (SELECT doc_id, line_start, CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in RULES) + " ELSE 'content' END AS kind FROM l) SELECT *, max(CASE WHEN kind = 'heading' THEN line_start END) OVER (PARTITION BY doc_id ORDER BY line_start) AS region FROM k",
    "benchmark_containment": r"""WITH n AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)
        SELECT doc_id, item_id FROM n JOIN i ON len(w) > 1 AND contains(t, ' ' || array_to_string(w, ' ') || ' ')""",
    "context_selection": r"WITH p AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, turn = 0 AS s FROM conversations), q AS (SELECT *, coalesce(lag(s) OVER o, false) OR coalesce(lead(s) OVER o, false) AS b, count(*) OVER (PARTITION BY conv_id) AS n, "
    + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS)) + " FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, "
    + ", ".join(f"count(*) FILTER (tf{i} > 0) OVER (PARTITION BY conv_id) AS df{i}" for i in range(len(_TERMS))) + " FROM q), z AS (SELECT conv_id, turn, s, b, round("
    + " + ".join(f"CASE WHEN tf{i} > 0 THEN (1 + ln(tf{i})) * ln((n + 1) / (df{i} + 1)) / sqrt(len(w)) ELSE 0 END" for i in range(len(_TERMS))) + ", 9) AS score FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, s OR b OR score <= 0 ORDER BY score DESC, turn) AS k FROM z) SELECT conv_id, turn, CASE WHEN s THEN 'support' WHEN b THEN 'neighbour' ELSE 'retrieved' END AS why FROM y WHERE s OR b OR (score > 0 AND k = 1)",
    "values_after_keys": r"SELECT event_id, unnest(regexp_extract_all(props, 'k[^\p{L}\p{N}]{0,3}([0-9]+)', 1)) AS value FROM events",
    "evidence_quotes": "WITH a AS (SELECT *, strpos(lower(text), 'que') AS p FROM conversations) SELECT conv_id, turn, replace(substring(text, greatest(p - 20, 1), p - greatest(p - 20, 1) + 23), chr(10), ' ') AS quote FROM a WHERE p > 0",
    "fenced_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "printed_prices": "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 1) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, unnest(CASE WHEN v = floor(v) THEN [v::BIGINT::VARCHAR] ELSE [printf('%.1f', v), replace(printf('%.1f', v), '.', ',')] END) AS form FROM v",
    "masked_turns": r"SELECT conv_id, turn, repeat(' ', least(10, length(text))) || text[11:12] || repeat(' ', greatest(0, least(17, length(text)) - 12)) || text[18:] AS rest FROM conversations WHERE regexp_replace(text[11:12] || text[18:], '\s', '', 'g') <> ''",
    "allowed_values": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '?' END AS kind FROM part",
    "reviewed_values": "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN upper(o_orderpriority) WHEN 'F' THEN NULL ELSE o_orderpriority END AS value, CASE o_orderstatus WHEN 'P' THEN 'EDITED' WHEN 'F' THEN 'REJECTED' ELSE 'MODEL' END AS state FROM orders",
    "work_order": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY abs(turn - 2) NULLS LAST, turn) AS place FROM conversations",
    "block_context": "SELECT conv_id, turn, sha256(coalesce(string_agg(trim(text, ' '), chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS before_sha, sha256(coalesce(trim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' '), '')) AS after_sha FROM conversations",
}
