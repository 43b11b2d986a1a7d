import re

import pytest

from docloom.llm import mixing as M


def targets(sizes):
    """{source: target} of {source: size}, by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left, share = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and weight[s] * left / share > 3 * sizes[s]} if share else set()
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * left / share for s in names}
        capped |= new


def test_whole_table(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = M.op6_cube(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    sizes, taken = {}, {}
    for r in got:
        d = docs[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) and (r.size == 0 or r.taken % r.size == 0) and 0 <= r.taken <= 3 * r.size
        sizes[d.source] = sizes.get(d.source, 0) + r.size
        taken[d.source] = taken.get(d.source, 0) + r.taken
    want = targets(sizes)
    for r in got:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 5 for s in want)


def test_rerun_and_partitions_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda d: sorted(tuple(r) for r in M.mix(d).collect())
    assert rows(docs) == rows(docs.repartition(5, "text"))


def test_blocks_fly_again(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 37 AS int)) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    got = M.mix(df, block=64).groupBy("target").sum("taken").collect()
    assert all(abs(r[0] - r[1]) <= 0.002 * r[0] for r in got)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z " * 1000, "b"), (5, "q", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS prob", "3 AS block")
    got = M.mix(df).collect()
    assert len(got) == 6 and {(r.doc_id, r.size) for r in got} == {(1, 0), (2, 0), (3, 2), (None, 1000), (5, 1)}
    assert all(r.taken <= 3 * r.size for r in got)
    assert M.mix(df.limit(0)).count() == 0


def test_rows_taken(spark):
    rows = [(i % 200, "w " * (1 + i % 7), "ab"[i % 2], f"r{i}") for i in range(600)]
    rows += [(5000, "same words here", "a", "x")] * 4 + [(None, "no id", "b", "y"), (6000, None, "a", "z"), (6001, "", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, name string").selectExpr("*", "'clash' AS target", "'clash' AS size")
    got = M.keep_taken(df).collect()
    assert got and got[0].__fields__ == ["doc_id", "text", "source", "name", "size", "target", "taken", "times"]
    assert all(r.size == len(r.text.split()) and r.taken == r.size * r.times > 0 for r in got)
    told = M.mix(df.where("doc_id is not null")).where("taken > 0").collect()
    key = lambda r: (r.doc_id, r.source, r.size, r.taken, r.target)
    assert sorted(map(key, got), key=str) == sorted(map(key, told), key=str)
    names = [r.name for r in got if r.name != "x"]
    assert len(set(names)) == len(names) and sum(r.name == "x" for r in got) <= 4
    assert M.keep_taken(df.limit(0)).count() == 0


def test_repeated_rows_are_dealt_to_all_blocks(spark):
    df = spark.range(4000).selectExpr("cast(if(id % 2 = 0, null, 7) AS long) AS doc_id", "'one two' AS text", "if(id % 4 < 3, 'a', 'b') AS source")
    got = M.mix(df, block=64)
    assert got.count() == 4000
    assert all(abs(r[0] - r[1]) <= 8 for r in got.groupBy("target").sum("taken").collect())
