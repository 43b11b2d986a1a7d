from docloom.operators import accounting, metrics


def test_multisets_with_nulls_and_dealt_orders(spark, sf, monkeypatch):
    """Null values equal no others; orders are dealt to as many tasks as the table's rows ask for."""
    gold = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, 2)], "k string, v int")
    said = spark.createDataFrame([("a", 1), ("a", 3), ("a", None)], "k string, v int")
    got = [tuple(r) for r in metrics.multiset_counts(gold, said, ["k"], "v", 3).collect()]
    assert sorted(got, key=str) == sorted([("a", 1, 1, 0, 1), ("a", 3, 0, 1, 0), ("a", None, 0, 0, 1), ("a", None, 0, 1, 0), (None, 2, 0, 0, 1)], key=str)
    monkeypatch.setattr(accounting, "tasks_for", lambda table: 40)
    assert accounting._cells(spark, sf, 3).rdd.getNumPartitions() == 40
