"""The bootstrap and the merge of lists against brute force."""

from docloom.operators import reconcile


def test_bootstrap_is_the_plain_one(spark):
    rows = [(i, "a" if i % 3 else None, float(i % 7) if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, g string, v double").repartition(5)
    got = {r.g: r for r in reconcile.bootstrap_interval(df, "g", "k", "v", draws=60).collect()}
    for g in ("a", None):
        mine = [(k, v) for k, h, v in rows if h == g and v is not None]
        weights = [reconcile.poisson_weights([k], 60, reconcile.SEED)[0] for k, _ in mine]
        means = sorted(sum(w[d] * v for w, (_, v) in zip(weights, mine)) / sum(w[d] for w in weights) for d in range(60))
        r = got[g]
        assert r.n == len(mine) and abs(r["mean"] - sum(v for _, v in mine) / len(mine)) < 1e-8
        assert abs(r.low - means[1]) < 1e-8 and abs(r.high - means[58]) < 1e-8
        assert r.low <= r["mean"] <= r.high


def test_items_joined_in_order(spark):
    reads = [(1, "x", 7), (1, "x", 7), (2, "x", 7), (2, "y", 7), (3, "x", 7), (3, "x", 7), (3, "x", 7), (1, None, 7)]
    df = spark.createDataFrame(reads, "reading int, item string, doc int")
    kept = []
    for reading, item, _ in reads:
        home = next((k for k in kept if k[0] == item and reading not in k[1]), None)
        if home:
            home[1].add(reading)
        else:
            kept.append((item, {reading}))
    got = reconcile.items_joined_once(df, "doc", "reading", "item").collect()
    assert sorted((r.item or "", r.readers) for r in got) == sorted((i or "", len(r)) for i, r in kept)


def test_empty(spark):
    df = spark.createDataFrame([], "k bigint, g string, v double")
    assert reconcile.bootstrap_interval(df, "g", "k", "v").collect() == []


def test_observations_dealt_by_rows(spark, sf, monkeypatch):
    rows = [(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 1), (2, 1, 1), (None, 1, 1), (None, 1, 2), (3, 3, None), (3, 3, 1)]
    got = reconcile.merged_observations(spark.createDataFrame(rows, "p int, s int, w int"), ["p", "s"], "w", 3).collect()
    assert {(r.p, r.s): (r.kept, r.ambiguous) for r in got} == {(1, 1): (1, False), (1, 2): (2, True), (2, 1): (1, False), (None, 1): (1, False), (3, 3): (2, True)}
    monkeypatch.setattr(reconcile, "tasks_for", lambda table: 40)
    assert reconcile.observations_of_parts(spark, sf).rdd.getNumPartitions() == 40
