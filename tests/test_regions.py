import random

import pytest

from docloom.operators import regions as G


def boxes_frame(spark, rows, extra=", label string"):
    return spark.createDataFrame(rows, "page long, id long, x0 double, y0 double, x1 double, y1 double" + extra)


def splits(boxes, lo, hi):
    """Groups of boxes with more than MIN_GAP between them along an axis, and the cuts between."""
    out, cuts, reach = [], [], None
    for b in sorted(boxes, key=lambda b: (b[lo], b[hi], b[1])):
        if reach is not None and b[lo] - reach > G.MIN_GAP:
            cuts.append((b[lo] + reach) / 2)
            out.append([])
        elif reach is None:
            out.append([])
        out[-1].append(b)
        reach = b[hi] if reach is None else max(reach, b[hi])
    return out, cuts


def cut(boxes, node, kind, x, y):
    columns, cuts = splits(boxes, 2, 4)
    if cuts:
        ends = [x[0], *cuts, x[1]]
        return {k: v for i, c in enumerate(columns) for k, v in cut(c, (*node, i), "column", (ends[i], ends[i + 1]), y).items()}
    width = max(b[4] for b in boxes) - min(b[2] for b in boxes)
    wide = {b[1] for b in boxes if b[4] - b[2] >= G.SPAN * width}
    if wide and len(splits([b for b in boxes if b[1] not in wide], 2, 4)[0]) > 1:
        bands, cuts = splits(boxes, 3, 5)
        merged, kept, before = [], [], None
        for i, band in enumerate(bands):
            has = any(b[1] in wide for b in band)
            if merged and not has and not before:
                merged[-1] += band
            else:
                merged.append(list(band))
                kept += cuts[i - 1 : i]
            before = has
        if len(merged) > 1:
            ends = [y[0], *kept, y[1]]
            return {k: v for i, c in enumerate(merged) for k, v in cut(c, (*node, i), "band", x, (ends[i], ends[i + 1])).items()}
    kind = "figure" if any(b[6] not in G.TEXT_LABELS for b in boxes) else kind
    return {b[1]: (list(node), kind, *x, *y) for b in boxes}


def test_recursive_cut(spark):
    rng, rows = random.Random(3), []
    for page in range(60):
        for i in range(rng.randrange(1, 25)):
            x, y = rng.randrange(0, 250), rng.randrange(0, 360)
            w = rng.choice([10, 30, 60, 280])
            rows.append((page, 1000 * page + i, float(0 if w == 280 else x), float(y), float(w if w == 280 else x + w), float(y + rng.randrange(3, 30)), rng.choice(["text"] * 9 + ["picture"])))
    got = {r.id: (list(r.node), r.kind, r.left, r.right, r.top, r.bottom) for r in G.page_leaves(boxes_frame(spark, rows), "page", 300, 400).collect()}
    want = {}
    for page in range(60):
        want |= cut([r for r in rows if r[0] == page], (), "page", (0.0, 300.0), (0.0, 400.0))
    assert got == want and max(len(v[0]) for v in want.values()) > 2


def test_cut_edges(spark):
    one = [(1, 1, 0.0, 0.0, 5.0, 5.0, "text"), (2, 2, None, 0.0, 5.0, 5.0, "text"), (3, 3, 0.0, 0.0, 5.0, 5.0, None), (3, 4, 0.0, 0.0, 5.0, 5.0, "text")]
    got = {r.id: (list(r.node), r.kind) for r in G.page_leaves(boxes_frame(spark, one), "page", 10, 10).collect()}
    assert got == {1: ([], "page"), 3: ([], "figure"), 4: ([], "figure")}
    assert G.page_leaves(boxes_frame(spark, one).limit(0), "page", 10, 10).count() == 0


def test_ten_thousand_boxes_of_one_page(spark):
    rows = [(1, i, float(i % 100) * 20, float(i // 100) * 20, float(i % 100) * 20 + 10, float(i // 100) * 20 + 10, "text") for i in range(10_000)]
    got = G.page_leaves(boxes_frame(spark, rows), "page", 2000, 2000)
    assert {(r.node, r.n) for r in got.groupBy("node").count().selectExpr("node[0] AS node", "count AS n").collect()} == {(i, 100) for i in range(100)}


def united(rows):
    out = []
    for page in {r[0] for r in rows}:
        left = [(r[1], *map(float, r[2:6]), 1) for r in rows if r[0] == page]
        moved = True
        while moved:
            moved = False
            for i in range(len(left)):
                for j in range(i):
                    a, b = left[i], left[j]
                    if max(a[1], b[1]) < min(a[3], b[3]) and max(a[2], b[2]) < min(a[4], b[4]):
                        left[j] = (min(a[0], b[0]), min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5])
                        del left[i]
                        moved = True
                        break
                if moved:
                    break
        out += [(page, *x) for x in left]
    return sorted(out)


@pytest.mark.parametrize("behind", [0, 2000])
def test_union_of_what_overlaps(spark, monkeypatch, behind):
    monkeypatch.setattr(G, "BEHIND", behind)
    rng, rows = random.Random(7), []
    for page in range(25):
        size = rng.choice([3, 8, 25])
        for i in range(rng.randrange(0, 40)):
            x, y = rng.randrange(-50, 100), rng.randrange(0, 100)
            rows.append((page, 1000 * page + i, x, y, x + rng.randrange(0, size), y + rng.randrange(0, size)))
    frame = spark.createDataFrame(rows, "page long, id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(tuple(r) for r in G.united_regions(frame).collect()) == united(rows)
    assert G.united_regions(frame.limit(0)).count() == 0


def test_union_grows_over_a_long_chain(spark):
    """A staircase of 400 boxes, and two arms that only meet after the first has grown over the second."""
    rows = [(1, i, float(i), float(i), i + 1.5, i + 1.5) for i in range(400)]
    rows += [(2, 1000, 0.0, 0.0, 100.0, 10.0), (2, 1001, 50.0, 5.0, 120.0, 50.0), (2, 1002, 20.0, 30.0, 40.0, 40.0), (2, 1003, 200.0, 0.0, 210.0, 10.0), (2, 1004, 210.0, 0.0, 220.0, 10.0)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted(tuple(r) for r in G.united_regions(boxes_frame(spark, rows, "")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == [(1, 0, 0.0, 0.0, 400.5, 400.5, 400), (2, 1000, 0.0, 0.0, 120.0, 50.0, 3), (2, 1003, 200.0, 0.0, 210.0, 10.0, 1), (2, 1004, 210.0, 0.0, 220.0, 10.0, 1)]


def test_places_of_regions(spark):
    items = [(1, 0, 0, 0, 100, 10, True), (1, 1, 0, 20, 40, 60, False), (1, 2, 0, 70, 40, 90, False), (1, 3, 50, 20, 90, 40, False), (1, 4, 0, 200, 100, 210, True), (2, 0, 0, 0, 10, 10, True)]
    regions = [(1, 1, 0, 61, 40, 69), (1, 2, 50, 45, 90, 60), (1, 3, 50, 5, 90, 15), (1, 4, 95, 50, 99, 60), (1, 5, 92, 10, 99, 15), (2, 6, 0, 20, 10, 30), (3, 7, 0, 0, 5, 5)]
    made = spark.createDataFrame(items, "page long, nth long, x0 long, y0 long, x1 long, y1 long, furniture boolean")
    placed = G.anchored(spark.createDataFrame(regions, "page long, region long, x0 long, y0 long, x1 long, y1 long"), made, "page")
    assert {r.region: r.at for r in placed.collect()} == {1: 2, 2: 4, 3: 3, 4: 4, 5: 1, 6: 1, 7: 0}
    order = [(r.item, r.region) for r in G.spliced(made.where("page = 1"), placed.where("page = 1"), "page").orderBy("key").collect()]
    assert order == [(0, None), (None, 5), (1, None), (None, 1), (2, None), (None, 3), (3, None), (None, 2), (None, 4), (4, None)]
