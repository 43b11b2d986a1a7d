"""Operators whose results can be counted by hand."""

import random

from pyspark.sql import functions as F

from docloom.operators import evidence as E
from docloom.operators import metrics as M
from docloom.operators import reconcile as R
from docloom.operators import sweeps as S
from docloom.operators import versions as V


def test_values_after_keys(spark):
    rows = [("Nr. 12, no: 7 and C.4)9",), ("NO7 no  8 no....9",), (None,), ("nothing 5",)]
    df = spark.createDataFrame(rows, "t string").select(E.values_after(F.col("t"), ["no", "Nr", "c.4)"], "[0-9]+").alias("v"))
    assert [r.v for r in df.collect()] == [["12", "7", "9"], ["7", "8"], None, []]


def test_exported_values(spark):
    rows = [(1, True, "EDITED", "e", "m"), (2, True, "REJECTED", "e", "m"), (3, True, None, None, "m"), (4, False, "EDITED", "e", "m"), (5, True, "APPROVED", None, "m"), (6, None, None, None, "m")]
    df = spark.createDataFrame(rows, "id int, saved boolean, action string, edit string, model string")
    out = E.exported_values(df, *(F.col(c) for c in ("saved", "action", "edit", "model")))
    assert {r.id: (r.value, r.state) for r in out.collect()} == {1: ("e", "EDITED"), 2: (None, "REJECTED"), 3: ("m", "MODEL"), 5: ("m", "APPROVED")}
    assert {r.id for r in E.in_review(out, "MODEL").collect()} == {3} and E.in_review(out, None).count() == 4


def test_retention(spark):
    rows = [("g", 1, "2024-01-01 00:00:00", "a"), ("g", 2, "2024-01-01 20:00:00", "a"), ("g", 3, "2024-01-01 00:00:00", "none"), ("h", 4, "2023-01-01 00:00:00", "a")]
    df = spark.createDataFrame(rows, "g string, id int, t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    got = V.retained(df, "g", "id", "t", F.col("k"), F.lit("2024-01-02 00:00:00").cast("timestamp"), {"a": 24})
    assert {r.id: r.may_go for r in got.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_rolled_up(spark):
    df = spark.createDataFrame([("a", "done"), ("a", "bad"), ("b", "done"), ("c", "odd"), ("c", "run")], "k string, s string")
    assert {tuple(r) for r in M.rolled_up(df, ["k"], "s", ["bad", "run", "done"]).collect()} == {("a", "bad", 2, 1, 0, 1), ("b", "done", 1, 0, 0, 1), ("c", "run", 2, 0, 1, 1)}


def test_changes(spark):
    side = lambda rows: spark.createDataFrame(rows, "k int, v string")
    got = R.changes(side([(1, "a"), (2, "b"), (3, None), (4, None)]), side([(1, "a"), (3, "c"), (4, None), (5, None)]), ["k"], "v")
    assert {r.k: r.change for r in got.collect()} == {1: "same", 2: "dropped", 3: "changed", 4: "same", 5: "added"}


def test_identities(spark):
    rows = [(1, "Grave A", "N  1", "x", ["p1", "p2"]), (2, "grave b", "n 1", "X", ["p2", "p3"]), (3, "Part", "n 1", None, ["p9"]), (4, "Part", "n 1", None, ["p8"]), (5, "part", "N 1", " ", ["p9"]), (6, "Part", None, None, None)]
    records, issues = R.identities(spark.createDataFrame(rows, "seq int, label string, no string, place string, pages array<string>"), ["no", "place"], "label", "seq", "pages")
    assert sorted((r.seq, r.label, r["items"], r.pages) for r in records.collect()) == [(1, "Grave A", 2, ["p1", "p2", "p3"]), (3, "Part", 2, ["p9"]), (4, "Part", 1, ["p8"]), (6, "Part", 1, [])]
    assert {(r.seq, r.missing) for r in issues.collect()} == {(3, "place"), (4, "place"), (5, "place"), (6, "no,place")}


def test_exactly_one_cell(spark):
    rng = random.Random(1)
    cells = [(rng.randrange(2), i, a, a + rng.randrange(1, 12)) for i in range(25) for a in [rng.randrange(60)]]
    spans = [(rng.randrange(2), i, a, a + rng.randrange(0, 5)) for i in range(80) for a in [rng.randrange(60)]]
    make = lambda rows: spark.createDataFrame(rows, "k int, i int, s int, e int")
    holds = {(k, i): [c[1] for c in cells if c[0] == k and c[2] <= a and z <= c[3] and (a < c[3])] for k, i, a, z in spans}
    got = {(r.k, r.span): r.cell for r in S.covering(make(spans), make(cells), "k", "i", "s", "e").collect()}
    assert got == {x: c[0] for x, c in holds.items() if len(c) == 1}
