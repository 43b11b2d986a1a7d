"""Small cases of claims, rounds and duplicates whose results can be counted by hand."""

from docloom.operators import accounting as A


def test_every_claim_once(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    claims = make([("a",), ("b",), ("c",), ("d",), ("d",)], "path string")
    issues = make([("c", "call_failed"), ("c", "call_failed"), ("c", "no_evidence"), ("d", "something"), ("b", "call_failed"), ("z", "call_failed")], "path string, code string")
    found = A.grounding_account(claims, make([("a", "filename")], "path string, policy string"), make([("b",), ("b",), ("a",)], "path string"), issues, ["path"])
    assert {(r.kind, r.name): r.n for r in found.collect()} == {
        ("total", "claims"): 4, ("total", "eligible"): 3, ("state", "excluded"): 1, ("state", "supported"): 1, ("state", "not_completed"): 1, ("state", "unsupported"): 1,
        ("policy", "filename"): 1, ("reason", "call_failed"): 1, ("reason", "no_evidence"): 1,
    }
    assert A.grounding_account(claims.limit(0), make([], "path string, policy string"), claims, issues, ["path"]).isEmpty()


def test_deltas_are_null_where_a_side_has_no_score(spark):
    side = lambda rows: spark.createDataFrame(rows, "f string, precision double, recall double, f1 double")
    got = A.score_deltas(side([("x", 0.5, None, 0.25), ("y", 1.0, 1.0, 1.0)]), side([("x", 0.75, 0.5, 0.25)]), "f")
    assert {tuple(r) for r in got.collect()} == {("x", 0.25, None, 0.0), ("y", None, None, None)}


def test_unjudged_cells_are_left_out(spark):
    cells = spark.createDataFrame([(1, "f", 2, 0, 0), (2, "f", 1, 1, 1), (3, "f", 0, 5, 5)], "d int, f string, tp int, fp int, fn int")
    verdicts = spark.createDataFrame([(1, "f", 9, 9, 9, 9), (2, "f", 2, 0, 0, 1)], "d int, f string, tp int, fp int, fn int, uncertain int")
    (r,) = A.judged_scores(cells, verdicts, ["d"], "f").collect()
    assert (r.tp, r.fp, r.fn, r.uncertain, r.judged, r.unjudged, r.f1) == (4, 0, 0, 1, 2, 1, 1.0)


def test_only_a_pair_drops_its_later_member(spark):
    """1 and 2 are a pair, 3 to 6 a chain; 7 lies in the same crop as 1, 8 has another text, 9 no text, 10 no crop in reach."""
    box = lambda i, crop, text, x, cx=0: (1, i, crop, text, x, x + 10, 0, 10, cx, cx + 50, 0, 50)
    rows = [box(1, 1, "A  b", 0), box(2, 2, "a b", 2), *(box(i, i, "c", 100 + 3 * i, 90) for i in (3, 4, 5, 6)), box(7, 1, "A b", 1, 500), box(8, 3, "x", 0), box(9, 4, None, 0), box(10, 5, "a b", 0, 900)]
    seen = spark.createDataFrame(rows, "place int, id int, crop int, text string, x0 int, x1 int, y0 int, y1 int, cx0 int, cx1 int, cy0 int, cy1 int")
    got = {tuple(r) for r in A.duplicate_marks(A.duplicate_pairs(seen)).collect()}
    assert got == {(1, 1, 2, "kept"), (2, 1, 2, "dropped"), *((i, 3, 4, "potential") for i in (3, 4, 5, 6))}
    assert A.duplicate_marks(A.duplicate_pairs(seen.limit(0))).isEmpty()
