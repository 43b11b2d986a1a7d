import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import sweeps as S

KIND = "k long, i long, s long, e long"


@pytest.fixture(params=[1, 8, 40])
def parts(spark, request):
    """Few and many ranges: an interval lies in one, or reaches over many."""
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def intervals(rng, n, first, hot=0.5):
    out = []
    for i in range(n):
        s = rng.randrange(100)
        out.append((0 if rng.random() < hot else rng.choice([1, 2, 3, None]), first + i, s, s + rng.choice([0, 1, 3, 10, 60])))
    return out


def meet(a, b):
    return a[0] is not None and a[0] == b[0] and (a[2] < b[3] and b[2] < a[3] or a[3] > a[2] == b[2] == b[3])


def test_pairs(spark, parts):
    rng = random.Random(parts)
    rows = [r for r in intervals(rng, 150, 0) if r[2] < r[3]]
    got = S.overlap_pairs(spark.createDataFrame(rows, KIND), None, "k", "i", "s", "e")
    assert sorted(tuple(r) for r in got.collect()) == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and meet(a, b))
    left, right = [r for r in intervals(rng, 100, 0) if r[2] < r[3]], intervals(rng, 100, 1000)
    got = S.overlap_pairs(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), "k", "i", "s", "e")
    assert got.columns == ["k", "a", "b"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((a[0], a[1], b[1]) for a in left for b in right if meet(a, b))


def test_covered_lengths(spark, parts):
    rng = random.Random(parts + 1)
    rows, cover = [r for r in intervals(rng, 80, 0) if r[0] is not None], intervals(rng, 200, 1000)
    got = {r.i: r.covered for r in S.covered_lengths(spark.createDataFrame(rows, KIND), spark.createDataFrame(cover, KIND), "k", "i", "s", "e").collect()}
    assert got == {a[1]: sum(max(0, min(a[3], b[3]) - max(a[2], b[2])) for b in cover if a[0] == b[0]) for a in rows}


def test_ancestors(spark, parts):
    rng = random.Random(parts + 2)
    path = lambda: [rng.choice(["a", "b", "ab", "ü", "\U0001f600", ""]) for _ in range(rng.randrange(5))]
    items, links = [(rng.randrange(3), i, path()) for i in range(80)], [(rng.randrange(3), i, path()) for i in range(80)] + [(1, 999, None)]
    make = lambda rows: spark.createDataFrame(rows, "g long, i long, p array<string>")
    got = sorted(tuple(r) for r in S.ancestors(make(links), make(items), "g", "i", "p").collect())
    assert got == sorted((g, i, j) for g, i, p in items for h, j, q in links if g == h and q is not None and q[: len(p)] == p)


def test_hot_key_is_shared(spark):
    """One key with all rows: its ranges are swept by many tasks, none with much more than its share."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(20_000).selectExpr("7L AS k", "id AS i", "id * 10 AS s", "id * 10 + 15 AS e")
        blocks = [r["count"] for r in S._ranged(rows, "k", "s").groupBy("block").count().collect()]
        assert len(blocks) == 16 and max(blocks) < 3000
        assert S.overlap_pairs(rows, None, "k", "i", "s", "e").count() == 19_999
        assert S.covered_lengths(rows, rows, "k", "i", "s", "e").agg(F.sum("covered")).first()[0] == 20_000 * 15 + 2 * 19_999 * 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    one = spark.createDataFrame([(1, 1, 0, 5)], KIND)
    assert S.overlap_pairs(none, None, "k", "i", "s", "e").count() == 0 == S.overlap_pairs(one, none, "k", "i", "s", "e").count()
    assert [tuple(r) for r in S.covered_lengths(one, none, "k", "i", "s", "e").collect()] == [(1, 0)]


def test_ranges_of_many_pairs_are_tasks_of_their_own(spark, monkeypatch):
    """Two thirds of the rows have one path, so most pairs are theirs; small ranges stay apart, and batches are small."""
    monkeypatch.setattr(S, "_BATCH", 7)
    rows = [(i, "h" if i % 3 else "g", ["a"] if i % 3 else ["a", str(i % 5)]) for i in range(300)]
    links = spark.createDataFrame(rows, "id long, host string, path array<string>")
    met = S.ancestors(links, links, "host", "id", "path", 40)
    want = sorted((h, j, i) for i, h, p in rows for j, g, q in rows if g == h and p[: len(q)] == q)
    assert sorted(tuple(r) for r in met.collect()) == want
    sizes = sorted(r["count"] for r in met.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect())
    assert len(sizes) >= 10 and sizes[-1] < len(want) / 5
