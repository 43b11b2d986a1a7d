"""Evidence from written runs: a round trip through page files and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.runs import passages, proved_pages, write_runs
from docloom.sources.tables import read_table as T
from docloom.sources.written import materialize, remove, shared_dir


def _conversation_pages(spark, sf) -> DataFrame:
    """Forty conversations make a run, a page each with its turns as segments; every seventh turn wasn't read."""
    t = T(spark, sf, "conversations").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    box = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    segment = F.struct(
        F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("label"), F.when(F.col("nth") % 7 == 0, "error").otherwise("ok").alias("status"), F.lit(0).alias("unit"),
        F.when(F.col("nth") % 2 == 0, 1).alias("crop"), box.alias("bbox_pt"), F.lit("block").alias("extent"),
    )
    pages = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    crop = F.struct(F.lit(1).alias("crop"), F.lit("column").alias("kind"), F.lit(0).alias("order"), box.alias("bbox_pt"), F.lit(0.5).alias("ink"))
    units = F.array(F.struct(F.lit(0).alias("index"), F.lit("pdf_page").alias("kind"), box.alias("bbox_pt"), F.array(crop).alias("crops")))
    return pages.select(F.concat(F.lit("r"), F.floor(F.col("conv_id") / 40)).alias("run"), (F.col("conv_id") % 40 + 1).cast("int").alias("page"), F.array(F.lit(100.0), F.lit(100.0)).alias("size_pt"), F.lit(True).alias("complete"), units.alias("units"), "segments")


def run_passages(spark, sf):
    """The passages of runs that were written, published and proved again."""
    folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    pages = _conversation_pages(spark, sf)
    runs = pages.groupBy("run").agg(F.max("page").alias("page_count")).select("run", F.create_map(F.lit("transcriber"), F.lit("turns")).alias("recipe"), F.col("run").alias("source_name"), "page_count", F.lit(None).cast("string").alias("incomplete"))
    write_runs(pages, runs, folder)
    proved, issues = proved_pages(spark, folder, {"transcriber": "turns"}, True)
    out = materialize(passages(proved).select("run", "page", "nth", "segment", "text", "label", "status", "crop_order", "withheld"))
    if not issues.isEmpty():
        raise RuntimeError(f"a run just written is refused: {issues.first()}")
    remove(spark, folder)
    return out


QUERIES = {"run_passages": run_passages}
ORACLES = {
    "run_passages": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
        SELECT 'r' || (conv_id // 40) AS run, CAST(conv_id % 40 + 1 AS INTEGER) AS page, CAST(k - 1 AS INTEGER) AS nth, 'p' || (conv_id % 40 + 1) || '_s' || (k - 1) AS segment, coalesce(text, '') AS text, role AS label,
            CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN k % 2 = 0 THEN 0 END AS crop_order, k % 7 = 0 AS withheld FROM t WHERE k % 7 = 0 OR regexp_matches(coalesce(text, ''), '\\S')""",
}
