"""Runs of page files with a manifest: written manifest last, read only with proof of every byte.

A folder holds `pages/generation=<g>/run=<run>/page=<n>/` with one file a page, and `manifests/commit=<c>/`, a line a run.
The manifests of a write appear by one rename after all its pages are there, so a reader sees whole generations only; a
write that stopped half-way has no manifests and is not seen. The newest commit that has a run is the run's result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.written import materialize, remove

#: The version that this source reads and writes. Fixed value.
VERSION = 5
_CROP = "struct<crop:int,kind:string,order:int,bbox_pt:array<double>,ink:double>"
PAGE = (
    f"generation string, page int, size_pt array<double>, complete boolean, warnings array<string>, markdown string, units array<struct<index:int,kind:string,bbox_pt:array<double>,crops:array<{_CROP}>>>, "
    "segments array<struct<text:string,html:string,markdown:string,label:string,confidence:double,status:string,unit:int,crop:int,bbox_pt:array<double>,extent:string>>"
)
MANIFEST = "run string, result_version int, generation string, digest string, recipe map<string,string>, source_name string, page_count int, status string, incomplete string, pages map<string,struct<sha256:string,complete:boolean>>"


def result_digest(pages: Column) -> Column:
    """The hash of a run's page hashes: of the canonical JSON of {pages: {number: sha256}}, whose keys sort as text."""
    items = F.transform(F.array_sort(F.map_entries(pages)), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":"'), x["value"]["sha256"], F.lit('"')))
    return F.sha2(F.concat(F.lit('{"pages":{'), F.array_join(items, ","), F.lit("}}")), 256)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, folder: str) -> list[int]:
    p, fs = _fs(spark, f"{folder}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("commit=")) for n in names if n.startswith("commit="))


def _page_files(spark: SparkSession, folder: str) -> DataFrame:
    """(generation, run, page, path, sha256, raw) of every page file, from its bytes and its place."""
    p, fs = _fs(spark, f"{folder}/pages")
    if not fs.exists(p):
        return spark.createDataFrame([], "generation string, run string, page int, path string, sha256 string, raw string")
    # read without the partition columns that Spark would guess types for: names may look like numbers
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/pages")
    place = lambda name: F.url_decode(F.replace(F.regexp_extract("path", rf"/{name}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    return files.select(place("generation").alias("generation"), place("run").alias("run"), place("page").cast("int").alias("page"), "path", F.sha2("content", 256).alias("sha256"), F.decode("content", "utf-8").alias("raw"))


def write_pages(pages: DataFrame, folder: str, generation: str) -> DataFrame:
    """Writes pages (run, page, raw), a file each, of a new generation, without a manifest; gives (run, page, sha256,
    complete) as read back from the bytes."""
    spark = pages.sparkSession
    files = pages.select(F.lit(generation).alias("generation"), "run", "page", "raw").repartitionByRange("run", "page")  # a run in one task or a few, so its folder is moved as a whole
    files.write.partitionBy("generation", "run", "page").mode("append").text(f"{folder}/pages")
    back = _page_files(spark, folder).where(F.col("generation") == generation)
    return materialize(back.select("run", "page", "sha256", F.from_json("raw", PAGE)["complete"].alias("complete")))


def commit(entries: DataFrame, runs: DataFrame, folder: str, generation: str) -> int:
    """Publishes the manifests of a generation: entries (run, page, sha256, complete) and runs (run, recipe, source_name,
    page_count, incomplete). They appear by a rename; if another writer took the number first, this one fails and its
    pages stay unseen. Gives the commit's number."""
    spark = entries.sparkSession
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page").cast("string"), F.struct("sha256", "complete")))))
    per = entries.groupBy("run").agg(listed.alias("pages"), F.min("complete").alias("whole"))
    made = runs.join(per, "run").select(
        "run", F.lit(VERSION).alias("result_version"), F.lit(generation).alias("generation"), result_digest(F.col("pages")).alias("digest"), "recipe", "source_name", "page_count",
        F.when(F.col("whole") & F.col("incomplete").isNull(), "success").otherwise("incomplete").alias("status"), "incomplete", "pages",
    )
    staged = f"{folder}/.staged-{uuid.uuid4().hex}"
    made.select(F.to_json(F.struct("*")).alias("value")).write.text(staged)
    number = max(_commits(spark, folder), default=0) + 1
    target, fs = _fs(spark, f"{folder}/manifests/commit={number:08d}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(_fs(spark, staged)[0], target):
        remove(spark, staged)
        raise RuntimeError(f"another write took commit {number}; its pages are kept, write again")
    return number


def write_runs(pages: DataFrame, runs: DataFrame, folder: str) -> str:
    """Writes whole runs as a new generation and publishes it. pages: (run, page, and the columns of PAGE but generation
    and page); runs: see commit(). Gives the generation's name."""
    generation = uuid.uuid4().hex
    names = [c.split(" ")[0] for c in PAGE.split(", ") if c.split(" ")[0] not in ("generation",)]
    body = F.to_json(F.struct(F.lit(generation).alias("generation"), *(F.col(n) for n in names if n in pages.columns)))
    entries = write_pages(pages.select("run", "page", body.alias("raw")), folder, generation)
    commit(entries, runs, folder, generation)
    return generation


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The newest manifest of each run: the columns of MANIFEST; a line that is no manifest has nulls but for `broken`."""
    commits = _commits(spark, folder)
    if not commits:
        return spark.createDataFrame([], f"{MANIFEST}, broken string")
    lines = spark.read.text(f"{folder}/manifests").select("commit", "value", F.from_json("value", MANIFEST).alias("m"))
    bad = F.col("m.run").isNull() | F.col("m.pages").isNull() | F.col("m.generation").isNull()
    latest = lines.where(~bad).groupBy("m.run").agg(F.max_by("m", "commit").alias("m")).select("m.*", F.lit(None).cast("string").alias("broken"))
    columns = [c for c in latest.columns if c != "broken"]
    return latest.unionByName(lines.where(bad).select(F.col("value").alias("broken"), *(F.lit(None).cast(latest.schema[c].dataType).alias(c) for c in columns)))


def proved_pages(spark: SparkSession, folder: str, expected: dict[str, str] | None = None, require_complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages, issues): the parsed pages (run, source_name, digest, and p: the page) of the runs that prove in all
    things, and (run, page, code, detail) of what speaks against the others.

    A run is refused as a whole for: a manifest of another version or that doesn't parse; a recipe that is not the
    expected one (by key); no pages, or pages beyond page_count; a status that doesn't follow from the entries, or that is
    not success where that is required; a page that is missing, not listed, of another number or generation, of other
    bytes, not parsing, or not as complete as listed; a digest that doesn't follow from the pages; a unit or crop that
    appears twice, or a segment in a unit or crop that its page or unit hasn't. Files of older generations are no issue.
    """
    manifests = read_manifests(spark, folder)
    good = manifests.where("broken IS NULL")
    files = _page_files(spark, folder)
    listed = good.select("run", "generation", F.explode("pages").alias("key", "entry")).select("run", "generation", F.col("key").cast("int").alias("page"), F.col("entry.sha256").alias("listed_sha"), F.col("entry.complete").alias("listed_complete"))
    have = files.join(good.select("run", "generation"), ["run", "generation"]).withColumn("p", F.from_json("raw", PAGE)).drop("raw")
    both = materialize(listed.join(have, ["run", "generation", "page"], "full"))
    units = F.transform(F.coalesce("p.units", F.array()), lambda u: u["index"])
    crops = F.flatten(F.transform(F.coalesce("p.units", F.array()), lambda u: F.transform(F.coalesce(u["crops"], F.array()), lambda c: F.struct(c["crop"].alias("crop"), u["index"].alias("unit")))))
    numbers = F.transform(crops, lambda c: c["crop"])
    segments = F.coalesce("p.segments", F.array())
    page_issues = {
        "missing": F.col("sha256").isNull(), "unlisted": F.col("listed_sha").isNull(), "malformed": F.col("sha256").isNotNull() & (F.col("p.page").isNull() | F.col("p.segments").isNull()),
        "page_number": F.col("p.page") != F.col("page"), "generation": F.col("p.generation") != F.col("generation"), "hash": F.col("sha256") != F.col("listed_sha"), "complete": F.col("p.complete") != F.col("listed_complete"),
        "unit_twice": F.size(F.array_distinct(units)) < F.size(units), "crop_twice": F.size(F.array_distinct(numbers)) < F.size(numbers),
        "unknown_unit": F.exists(segments, lambda s: ~F.array_contains(units, F.coalesce(s["unit"], F.lit(-1)))),
        "unknown_crop": F.exists(segments, lambda s: s["crop"].isNotNull() & ~F.exists(crops, lambda c: (c["crop"] == s["crop"]) & (c["unit"] == s["unit"]))),
    }
    low = F.array_min(F.transform(F.map_keys("pages"), lambda k: k.cast("int")))
    high = F.array_max(F.transform(F.map_keys("pages"), lambda k: k.cast("int")))
    whole = F.col("incomplete").isNull() & F.forall(F.map_values("pages"), lambda e: F.coalesce(e["complete"], F.lit(False)))
    run_issues = {
        "version": ~F.col("result_version").eqNullSafe(VERSION), "no_pages": F.size("pages") == 0, "page_range": (low < 1) | (high > F.col("page_count")),
        "status": (F.col("status") == "success") != whole, "digest": ~result_digest(F.col("pages")).eqNullSafe(F.col("digest")),
    }
    if require_complete:
        run_issues["incomplete"] = F.col("status") != "success"
    for key, value in (expected or {}).items():
        run_issues[f"recipe_{key}"] = ~F.element_at("recipe", F.lit(key)).eqNullSafe(F.lit(value))
    named = lambda tests: F.explode(F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())).alias("code")
    issues = both.select("run", "page", named(page_issues), F.coalesce("path", "listed_sha").alias("detail"))
    issues = issues.union(good.select("run", F.lit(None).cast("int").alias("page"), named(run_issues), F.col("generation").alias("detail")))
    issues = materialize(issues.union(manifests.where("broken IS NOT NULL").select("run", F.lit(None).cast("int"), F.lit("manifest"), "broken")))
    refused = issues.select("run").distinct()
    pages = both.join(refused, "run", "left_anti").join(good.select("run", "source_name", "digest"), "run").select("run", "source_name", "digest", "p")
    return pages, issues


def passages(pages: DataFrame) -> DataFrame:
    """(run, page, nth, segment, text, label, status, unit, crop, crop_order, bbox_pt, crop_bbox_pt, extent, withheld): the
    segments of proved pages in reading order, named p<page>_s<nth>. Blank ones that were read go; ones that weren't are
    withheld."""
    s = pages.select("run", "p.page", "p.units", F.posexplode("p.segments").alias("nth", "s"))
    crops = F.flatten(F.transform("units", lambda u: F.coalesce(u["crops"], F.array().cast(f"array<{_CROP}>"))))
    s = s.withColumn("c", F.get(F.filter(crops, lambda c: c["crop"] == F.col("s.crop")), F.lit(0)))
    kept = s.where(~((F.col("s.status") == "ok") & ~F.coalesce(F.col("s.text"), F.lit("")).rlike(r"(?U)\S")))
    return kept.select(
        "run", "page", "nth", F.concat(F.lit("p"), "page", F.lit("_s"), "nth").alias("segment"), "s.text", "s.label", "s.status", "s.unit", "s.crop", F.col("c.order").alias("crop_order"), "s.bbox_pt",
        F.col("c.bbox_pt").alias("crop_bbox_pt"), "s.extent", (F.col("s.status") != "ok").alias("withheld"),
    )


def drop_old_generations(spark: SparkSession, folder: str) -> int:
    """Removes the page files of generations that no run's newest manifest names; gives their number. Not to be run while
    a write is under way, whose manifests are still to come."""
    used = {r["generation"] for r in read_manifests(spark, folder).where("broken IS NULL").select("generation").distinct().collect()}
    p, fs = _fs(spark, f"{folder}/pages")
    there = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    old = [x.toString() for x in there if x.getName().startswith("generation=") and x.getName().removeprefix("generation=") not in used]
    for path in old:
        remove(spark, path)
    return len(old)
