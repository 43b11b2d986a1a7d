"""Text cut into lines, chunks and runs, each with its exact place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.functions.text import fold_spaces, words
from docloom.sources.tables import read_table as T


_BLANKS = " \t\r\x0b\x0c"
#: Lines, and code points of lines, that leave a task together.
_MOST_ROWS, _MOST_CHARS = 20_000, 1 << 21


def _cut_lines(docs: DataFrame, key: str, text: str, with_line: bool) -> DataFrame:
    schema = StructType([StructField(key, docs.select(key).schema[0].dataType), StructField("line_start", LongType()), StructField("line_end", LongType()), *([StructField("line", StringType())] if with_line else [])])

    def run(batches):
        for b in batches:
            took, starts, ends, lines, chars = [], [], [], [], 0
            for i, t in enumerate(b.column(1)):
                at = 0
                for line in (t.as_py() or "").split("\n"):
                    body = line.strip(_BLANKS)
                    if body:
                        a = at + len(line) - len(line.lstrip(_BLANKS))
                        took.append(i)
                        starts.append(a)
                        ends.append(a + len(body))
                        if with_line:
                            lines.append(body)
                            chars += len(body)
                    at += len(line) + 1
                    if len(took) >= _MOST_ROWS or chars >= _MOST_CHARS:
                        yield _batch(b, took, starts, ends, lines)
                        took, starts, ends, lines, chars = [], [], [], [], 0
            yield _batch(b, took, starts, ends, lines)

    def _batch(b, took, starts, ends, lines):
        keys = b.column(0).take(pa.array(took, pa.int64()))
        return pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), *([pa.array(lines, pa.string())] if with_line else [])], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_start, line_end, line) of every non-blank line, without the blanks around it. Null texts have no lines.

    One pass over each text; what leaves it are its lines, never the text itself, in batches of bounded size.
    """
    return _cut_lines(docs, key, text, True)


def line_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_start, line_end) of text_lines; the lines stay in the tasks."""
    return _cut_lines(docs, key, text, False)


def line_lengths(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n): the code points of every line of text_lines, without its place: native, so texts stay where they are."""
    cut = docs.select(*keys, F.explode(F.split(text, "\n")).alias("line"))
    return cut.select(*keys, F.length(F.btrim("line", F.lit(_BLANKS))).cast("bigint").alias("n")).where("n > 0")


_LINES_SQL = r"""
    WITH p AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p),
    t AS (SELECT *, length(line) - length(ltrim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS lead, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS body FROM o),
    spans AS (SELECT doc_id, lang, (pos + lead)::BIGINT AS line_start, (pos + lead + length(body))::BIGINT AS line_end FROM t WHERE body <> '')"""


def lines_of_documents(spark, sf):
    return line_spans(T(spark, sf, "documents"))


def line_stats_by_lang(spark, sf):
    n = F.col("n")
    return line_lengths(T(spark, sf, "documents"), ["lang"]).groupBy("lang").agg(F.count("*").alias("n_lines"), F.max(n).alias("longest"), F.sum(n).alias("n_chars"))


def fixed_chunks(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of `size` code points that cover each text once."""
    n = F.length(text)
    starts = docs.where(n > 0).select(key, n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("s"))
    return starts.select(key, F.col("s").cast("bigint").alias("start"), F.least(F.col("s") + size, "n").cast("bigint").alias("end"))


def fixed_chunks_500(spark, sf):
    return fixed_chunks(T(spark, sf, "documents"), 500)


def balanced_pieces(df: DataFrame, pieces: int, group: list[str], order: list[str]) -> DataFrame:
    """Adds piece: the rows of a group in order, in so many runs whose sizes differ by one at most."""
    w = Window.partitionBy(*group)
    i = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn("piece", F.floor(i * pieces / F.count("*").over(w)).cast("bigint"))


def balanced_pieces_of_sources(spark, sf):
    rows = balanced_pieces(T(spark, sf, "documents").select("source", "doc_id"), 4, ["source"], ["doc_id"])
    return rows.groupBy("source", "piece").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def islands(df: DataFrame, group: list[str], order: list[str], same: str) -> DataFrame:
    """Adds run: numbers from 1 the stretches of neighbouring rows with one value of `same`."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w)).drop("__new")


def role_runs(spark, sf):
    runs = islands(T(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_frequencies_of_turns(spark, sf):
    return term_frequencies(T(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text"), "k").select("k.conv_id", "k.turn", "term", "tf")


def duplicate_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of texts that are equal but for case and spacing, by content hash; texts never meet in one row."""
    return docs.where(F.col(text).isNotNull()).groupBy(F.sha2(fold_spaces(F.col(text)), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def duplicate_texts_normalised(spark, sf):
    return duplicate_texts(T(spark, sf, "documents"))


def content_digests(spark, sf):
    return T(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


QUERIES = {f.__name__: f for f in (lines_of_documents, line_stats_by_lang, fixed_chunks_500, balanced_pieces_of_sources, role_runs, term_frequencies_of_turns, duplicate_texts_normalised, content_digests)}
ORACLES = {
    "lines_of_documents": _LINES_SQL + " SELECT doc_id, line_start, line_end FROM spans",
    "line_stats_by_lang": _LINES_SQL + " SELECT lang, count(*) AS n_lines, max(line_end - line_start) AS longest, sum(line_end - line_start)::BIGINT AS n_chars FROM spans GROUP BY lang",
    "fixed_chunks_500": "SELECT doc_id, s::BIGINT AS start, least(s + 500, length(text))::BIGINT AS \"end\" FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS s FROM documents)",
    "balanced_pieces_of_sources": "SELECT source, piece, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT source, doc_id, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * 4 / count(*) OVER (PARTITION BY source))::BIGINT AS piece FROM documents) GROUP BY source, piece",
    "role_runs": """WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM f)
        SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY user_id, run""",
    "term_frequencies_of_turns": r"SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations) GROUP BY ALL",
    "duplicate_texts_normalised": "SELECT sha256(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "content_digests": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS n_bytes FROM documents",
}
