"""Records of unlike schemas in one table: a registry of fields by name and shape, and the union of all records' fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import read_table as T



def shape_words(kind: Column, items: Column) -> Column:
    """object, list of objects, list of <items>, or the scalar type."""
    return F.when(kind == "array", F.concat(F.lit("list of "), F.coalesce(items, F.lit("objects")))).otherwise(kind)


def field_registry(values: DataFrame, seq: str, name: str, shape: str, words: str, declared: DataFrame | None = None) -> DataFrame:
    """(name, shape, column, place, ambiguous): a column for each name and shape that values (seq, name, shape, words) have.

    Columns stand in the order of first appearance; shapes that `declared` (name, shape, place) lists too come first, in
    its order, but it brings no columns of its own. The first shape of a name keeps the name; the others are called by
    their words too, `year (string)`, numbered from 2 where that is taken. ambiguous: the name has several. The registry
    is an aggregate by name and shape, so parts of a batch merge; only what was produced counts, in any order of rows.
    """
    seen = values.groupBy(F.col(name).alias("name"), F.col(shape).alias("shape")).agg(F.min(F.struct(F.col(seq).alias("seq"), F.col(words).alias("words"))).alias("first"))
    if declared is not None:
        seen = seen.join(declared.groupBy("name", "shape").agg(F.min("place").alias("said")), ["name", "shape"], "left")
    else:
        seen = seen.withColumn("said", F.lit(None).cast("long"))
    key = [F.col("said").asc_nulls_last(), F.col("first.seq"), F.col("shape")]
    of_name, of_words = Window.partitionBy("name"), Window.partitionBy("name", "first.words")
    told = seen.withColumns({"nth": F.row_number().over(of_name.orderBy(*key)), "shapes": F.count("*").over(of_name)})
    told = told.withColumn("like", F.row_number().over(of_words.orderBy((F.col("nth") == 1).desc(), *key)) - F.max((F.col("nth") == 1).cast("int")).over(of_words))
    called = lambda n: F.when(n == 1, F.concat("name", F.lit(" ("), "words", F.lit(")"))).otherwise(F.concat("name", F.lit(" ("), "words", F.lit(", "), n.cast("string"), F.lit(")")))
    # the n-th free number: numbers whose name is some field's own are passed over
    others = told.where("nth > 1").select("name", "shape", F.col("first.words").alias("words"), "like")
    wanted = others.groupBy("name", "words").agg(F.max("like").alias("most"))
    taken = seen.select(F.col("name").alias("column")).distinct()
    prefix = taken.join(wanted.select("name", "words"), F.startswith("column", F.concat("name", F.lit(" ("), "words"))).groupBy("name", "words").agg(F.count("*").alias("met"))
    tried = wanted.join(prefix, ["name", "words"], "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("most") + F.coalesce("met", F.lit(0)).cast("int")))).withColumn("column", called(F.col("n")))
    free = tried.join(taken, "column", "left_anti").withColumn("like", F.row_number().over(Window.partitionBy("name", "words").orderBy("n"))).select("name", "words", "like", "column")
    renamed = others.join(free, ["name", "words", "like"]).select("name", "shape", F.col("column").alias("renamed"))
    out = told.join(renamed, ["name", "shape"], "left").withColumns({"column": F.coalesce("renamed", "name"), "ambiguous": F.col("shapes") > 1})
    # a place that needs no common window: the order itself is the place
    return out.select("name", "shape", "column", F.struct(F.col("said").isNull().alias("late"), F.col("said"), F.col("first.seq").alias("seq"), F.col("shape").alias("tie")).alias("place"), "ambiguous")


def union_of_records(values: DataFrame, registry: DataFrame, record: str, name: str, shape: str, value: str) -> DataFrame:
    """(record, column, place, value): every record's values under the columns of the registry, none dropped or merged
    with one of another type. Values without a record are shared: each record gets them, but where it has its own."""
    named = values.join(registry.select(F.col("name").alias(name), F.col("shape").alias(shape), "column", "place"), [name, shape]).select(record, "column", "place", value)
    own = named.where(F.col(record).isNotNull())
    shared = named.where(F.col(record).isNull()).drop(record)
    everywhere = own.select(record).distinct().join(F.broadcast(shared)).join(own.select(record, "column"), [record, "column"], "left_anti")
    return own.unionByName(everywhere)


def typed_fields(spark, sf):
    """Fields named by the line's number, of a type by its flag; a field has as many columns as types."""
    li = T(spark, sf, "lineitem")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    kind = F.element_at(F.create_map(*map(F.lit, ("A", "string", "N", "number", "R", "array"))), F.col("l_returnflag"))
    values = li.select(seq.alias("seq"), F.concat(F.lit("f"), (F.col("l_linenumber") % 4).cast("string")).alias("name"), F.concat(kind, (F.col("l_partkey") % 2).cast("string")).alias("shape"), shape_words(kind, F.lit("string")).alias("words"))
    return field_registry(values, "seq", "name", "shape", "words").select("name", "shape", "column", "ambiguous")


QUERIES = {"typed_fields": typed_fields}
ORACLES = {
    "typed_fields": """WITH v AS (SELECT [l_orderkey, l_linenumber, l_partkey, ascii(l_returnflag)] AS seq, 'f' || (l_linenumber % 4) AS name, CASE l_returnflag WHEN 'A' THEN 'string' WHEN 'N' THEN 'number' ELSE 'array' END AS kind, l_partkey % 2 AS odd FROM lineitem),
        s AS (SELECT name, kind || odd AS shape, CASE kind WHEN 'array' THEN 'list of string' ELSE kind END AS words, min(seq) AS seq FROM v GROUP BY 1, 2, 3),
        t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq, shape) AS nth FROM s),
        u AS (SELECT *, row_number() OVER (PARTITION BY name, words, nth = 1 ORDER BY seq, shape) AS k FROM t)
        SELECT name, shape, CASE WHEN nth = 1 THEN name WHEN k = 1 THEN name || ' (' || words || ')' ELSE name || ' (' || words || ', ' || k || ')' END AS column, count(*) OVER (PARTITION BY name) > 1 AS ambiguous FROM u""",
}
