"""Written runs: each way in which a run can fail to prove itself is refused by name, and unpublished work is not seen."""

import hashlib
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from docloom.sources import runs as R


def page(run, n, texts, **more):
    segments = [{"text": t, "label": "text", "status": s, "unit": 0, "crop": c, "extent": "block"} for t, s, c in texts]
    units = [{"index": 0, "kind": "pdf_page", "crops": [{"crop": 7, "order": 0, "bbox_pt": [0.0, 0.0, 9.0, 9.0]}]}]
    return {"run": run, "page": n, "complete": True, "units": units, "segments": segments} | more


PAGES = [page("007", 1, [("one", "ok", None), ("  ", "ok", None), ("two", "error", 7)]), page("007", 2, []), page("a b/ü+c", 1, [("three", "ok", 7)]), page("a b/ü+c", 10, [("x", "ok", None)]), page("a b/ü+c", 2, [("y", "ok", None)])]
RUN = "run string, recipe map<string,string>, source_name string, page_count int, incomplete string"


def pages_frame(spark, pages):
    kinds = "run string, page int, complete boolean, " + ", ".join(c for c in R.PAGE.split(", ") if c.split(" ")[0] in ("units", "segments"))
    return spark.createDataFrame([(json.dumps(p),) for p in pages], "j string").select(F.from_json("j", kinds).alias("p")).select("p.*")


@pytest.fixture
def folder(spark, tmp_path):
    where = f"{tmp_path}/runs"
    runs = spark.createDataFrame([("007", {"source": "s1"}, "first", 3, None), ("a b/ü+c", {"source": "s2"}, "second", 10, None)], RUN)
    R.write_runs(pages_frame(spark, PAGES), runs, where)
    return where


def manifest_file(folder):
    return next(p for d in sorted(pathlib.Path(folder, "manifests").iterdir())[-1:] for p in d.glob("part-*") if p.stat().st_size)


def edit(folder, run, change):
    """Changes a manifest's fields in place."""
    for d in pathlib.Path(folder, "manifests").iterdir():
        for path in d.glob("part-*"):
            lines = [json.loads(x) for x in path.read_text().splitlines()]
            for m in lines:
                if m["run"] == run:
                    change(m)
            path.write_text("".join(json.dumps(m) + "\n" for m in lines))
    for crc in pathlib.Path(folder).rglob("*.crc"):
        crc.unlink()


def page_file(folder, run, n):
    (path,) = (p for p in pathlib.Path(folder).rglob("part-*") if f"/run={run}/page={n}/" in str(p))
    return path


def codes(spark, folder, **more):
    pages, issues = R.proved_pages(spark, folder, **more)
    return {(r.run, r.code) for r in issues.collect()}, {r.run for r in pages.select("run").collect()}


def test_round_trip(spark, folder):
    pages, issues = R.proved_pages(spark, folder, {}, True)
    assert issues.isEmpty()
    got = sorted((r.run, r.page, r.segment, r.text, r.crop_order, r.withheld) for r in R.passages(pages).collect())
    assert got == [("007", 1, "p1_s0", "one", None, False), ("007", 1, "p1_s2", "two", 0, True), ("a b/ü+c", 1, "p1_s0", "three", 0, False), ("a b/ü+c", 2, "p2_s0", "y", None, False), ("a b/ü+c", 10, "p10_s0", "x", None, False)]
    for m in R.read_manifests(spark, folder).collect():
        shas = {k: v.sha256 for k, v in m.pages.items()}
        assert m.digest == hashlib.sha256(json.dumps({"pages": shas}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    raw = page_file(folder, "007", 2).read_bytes()
    assert hashlib.sha256(raw).hexdigest() in {v.sha256 for m in R.read_manifests(spark, folder).collect() for v in m.pages.values()}


def test_expectations(spark, folder):
    assert codes(spark, folder, expected={"source": "s1"}) == ({("a b/ü+c", "recipe_source")}, {"007"})


def test_missing_changed_and_unlisted_pages(spark, folder):
    page_file(folder, "007", 2).unlink()
    assert codes(spark, folder) == ({("007", "missing")}, {"a b/ü+c"})


def test_wrong_bytes(spark, folder):
    path = page_file(folder, "007", 1)
    path.write_text(path.read_text().replace("one", "ONE"))
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    assert codes(spark, folder) == ({("007", "hash")}, {"a b/ü+c"})


def test_malformed_page(spark, folder):
    path = page_file(folder, "007", 1)
    path.write_text("{broken")
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    assert codes(spark, folder)[0] == {("007", "hash"), ("007", "malformed")}


def listed(m):
    """A manifest whose digest follows from its pages again."""
    m["digest"] = hashlib.sha256(json.dumps({"pages": {k: v["sha256"] for k, v in m["pages"].items()}}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


CHANGES = {
    "version": lambda m: m.update(result_version=4),
    "digest": lambda m: m.update(digest="0" * 64),
    "status": lambda m: m.update(status="incomplete"),
    "page_range": lambda m: m.update(page_count=1),
    "unlisted": lambda m: (m["pages"].pop("2"), listed(m)),
    "no_pages": lambda m: (m["pages"].clear(), listed(m)),
    "complete": lambda m: (m["pages"]["1"].update(complete=False), m.update(status="incomplete", incomplete="cut")),
    "missing": lambda m: m.update(generation="gone"),
}


@pytest.mark.parametrize("code", CHANGES)
def test_manifest_that_does_not_hold(spark, folder, code):
    edit(folder, "007", CHANGES[code])
    found, runs = codes(spark, folder)
    assert ("007", code) in found and {r for r, _ in found} == {"007"} and runs == {"a b/ü+c"}


def test_broken_manifest_line(spark, folder):
    path = manifest_file(folder)
    path.write_text(path.read_text() + "{half")
    for crc in pathlib.Path(folder).rglob("*.crc"):
        crc.unlink()
    assert codes(spark, folder) == ({(None, "manifest")}, {"007", "a b/ü+c"})


def test_placement(spark, tmp_path):
    odd = [page("u", 1, [("a", "ok", None)], units=[{"index": 0, "crops": []}, {"index": 0, "crops": []}]), page("c", 1, [("a", "ok", 3)]), page("w", 1, [], units=[{"index": 0, "crops": [{"crop": 1}, {"crop": 1}]}]), page("n", 1, [("a", "ok", None)], units=[])]
    runs = spark.createDataFrame([(r, {}, r, 1, None) for r in "ucwn"], RUN)
    R.write_runs(pages_frame(spark, odd), runs, f"{tmp_path}/r")
    assert codes(spark, f"{tmp_path}/r") == ({("u", "unit_twice"), ("c", "unknown_crop"), ("w", "crop_twice"), ("n", "unknown_unit")}, set())


def test_half_written_generation_is_not_seen(spark, folder):
    """Pages of a newer generation without its manifests change nothing; published, they replace the run as a whole."""
    newer = pages_frame(spark, [page("007", 1, [("newer", "ok", None)])])
    raw = newer.select("run", "page", F.to_json(F.struct(F.lit("g2").alias("generation"), "page", "complete", "units", "segments")).alias("raw"))
    entries = R.write_pages(raw, folder, "g2")
    texts = lambda: {r.text for r in R.passages(R.proved_pages(spark, folder)[0]).where("run = '007'").collect()}
    assert texts() == {"one", "two"}
    R.commit(entries, spark.createDataFrame([("007", {}, "first", 1, None)], RUN), folder, "g2")
    assert texts() == {"newer"} and codes(spark, folder)[0] == set()
    assert R.drop_old_generations(spark, folder) == 0  # the other run still needs the first one


def test_two_writers(spark, folder, monkeypatch):
    monkeypatch.setattr(R, "_commits", lambda *_: [])
    entries = R.write_pages(spark.createDataFrame([("z", 1, '{"generation":"g","page":1,"complete":true,"units":[],"segments":[]}')], "run string, page int, raw string"), folder, "g")
    with pytest.raises(RuntimeError, match="write again"):
        R.commit(entries, spark.createDataFrame([("z", {}, "z", 1, None)], RUN), folder, "g")
    monkeypatch.undo()
    assert codes(spark, folder) == (set(), {"007", "a b/ü+c"}) and R.drop_old_generations(spark, folder) == 1


def test_nothing_there(spark, tmp_path):
    pages, issues = R.proved_pages(spark, f"{tmp_path}/none")
    assert pages.isEmpty() and issues.isEmpty() and R.drop_old_generations(spark, f"{tmp_path}/none") == 0


def test_a_run_is_written_by_few_tasks(spark, tmp_path):
    """Tasks take ranges of pages, so of runs and tasks only as many meet as ranges have ends."""
    pages = spark.range(80).selectExpr("concat('r', id % 4) AS run", "CAST(id div 4 + 1 AS INT) AS page", "'{\"complete\":true}' AS raw")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert R.write_pages(pages, f"{tmp_path}/r", "g").count() == 80
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    met = {(p.parent.parent.name, p.name.split("-")[1]) for p in (tmp_path / "r").rglob("part-*")}
    assert len(met) <= 4 + 8 - 1
