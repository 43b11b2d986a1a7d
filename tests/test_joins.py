import random

from docloom.operators import joins


def test_boxes_dealt_by_rows(spark, sf, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(1, 50), y + rng.randrange(1, 50)) for i in range(120)]
    want = set()
    for p, i, x0, y0, x1, y1 in rows:
        for q, j, u0, v0, u1, v1 in rows:
            w, h = min(x1, u1) - max(x0, u0), min(y1, v1) - max(y0, v0)
            if p == q and i < j and w > 0 and h > 0 and w * h / ((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - w * h) >= 0.2:
                want.add((p, i, j))
    boxes = spark.createDataFrame(rows, "page int, id int, x0 int, y0 int, x1 int, y1 int")
    got = [(r.page, r.a, r.b) for r in joins.boxes_iou(boxes, "page", "id", 16, 0.2, 5).collect()]
    assert want and len(got) == len(want) and set(got) == want
    monkeypatch.setattr(joins, "tasks_for", lambda table, rows: 40)
    plan = joins.box_iou_pairs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert [x.rsplit(", ", 1)[1] for x in plan.splitlines() if "RepartitionByExpression" in x] == ["40", "40"]
