"""From raw documents to a mixed training corpus: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize, table
from docloom.llm.decontaminate import drop_leaks
from docloom.llm.nearcopies import keep_one_of_each
from docloom.llm.langid import keep_identified
from docloom.llm.mixing import keep_taken
from docloom.llm.surrogates import key_of_run, replace_entities
from docloom.sources.written import only_kept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of no known language go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (wide SimHash fingerprints, then five-word shingles of Jaccard similarity 0.8 or more)
    the smallest doc_id stays."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; n_chars follows the text."""
    return replace_entities(docs, key=key_of_run(spark)).withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, target (of the source), taken (words) and times."""
    return keep_taken(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("private_data", private_data), ("mixing", mixing)]
#: Not expressible in SQL (a trained model comes first); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote besides its result, and the input it read, go when it is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with only_kept() as kept:
            out = materialize(stage(spark, docs, sf_dir))
            kept.append(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
