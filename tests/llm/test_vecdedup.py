import hashlib
import math
import random

import numpy as np

from docloom.llm import vecdedup as V
from docloom.operators import graph
from tests.test_queries import canon, duck


def brute(rows, dims, k, rounds, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest())
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        where = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), w in zip(kept, where) if w == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [near(v) for _, v in kept]
    inertia = {j: sum(d for d, w in last if w == j) for _, j in last}
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), cents[j]) for (i, _), (d, j) in zip(kept, last)], key=repr)


def rows_of(df):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in df.collect()], key=repr)


def test_against_sql(spark, sf):
    got = V.op11_vecdedup(spark, sf)
    cur = duck(sf).execute(V.ORACLES["op11_vecdedup"])
    names = [d[0] for d in cur.description]
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(cur.fetchall(), names)


def test_random_vectors_with_copies(spark):
    rng = random.Random(4)
    pool = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    rows = [(i, rng.choice(pool)) for i in range(200)] + [(500 + i, [0.001, 0.002, 0.0, 0.003]) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    assert rows_of(V.weighted_kmeans(frame, "id", "v", 4, 7, 4)) == brute(rows, 4, 7, 4)


def test_hot_vector_is_joined_where_it_lies(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 10)
    monkeypatch.setattr(graph, "SHARE", 10)
    rows = [(i, [1.0, 2.0] if i % 2 else [i / 7, -i / 3]) for i in range(100)]
    assert rows_of(V.weighted_kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dims=2, k=5)) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 2, 5, 5)


def test_edges(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [5.0, 5.0]), (8, [-300.0, 40000.0]), (9, [0.0, -0.0]), (10, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS key", "3 AS w")
    assert rows_of(V.weighted_kmeans(frame, dims=2, k=3)) == brute(rows, 2, 3, 5)
    assert rows_of(V.weighted_kmeans(frame, dims=2, k=40)) == brute(rows, 2, 40, 5)
    assert V.weighted_kmeans(frame.limit(0), dims=2).count() == 0
    assert V.weighted_kmeans(frame, dims=9).count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-5e5, 5e5) for _ in range(3)]) for i in range(60)] + [(99, [1e30, 0.0, 0.0])]
    want = brute(rows[:-1], 3, 4, 3)  # the last one's distances would not fit 64 bits
    assert rows_of(V.weighted_kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=3, k=4, rounds=3)) == want


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    q = np.concatenate([rng.integers(-m, m, (20, 6)) for m in (3, 128, 129, 1 << 15, (1 << 15) + 1, 1 << 27)])
    keys = V._packed(q)
    assert (V._unpacked(keys, 6) == q).all() and {len(k) for k in keys} == {6, 12, 24}


def test_ties_go_to_the_smaller_number():
    best, d = V.nearest(np.array([[0, 0], [4, 0]]), np.array([[2, 0], [-2, 0], [2, 0]]))
    assert best.tolist() == [0, 0] and d.tolist() == [4, 4]
    assert (V.nearest(np.array([[1 << 26, 0]]), np.array([[0, 0], [1 << 26, 1]]))[1] == [1]).all()
