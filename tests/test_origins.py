import json
import random

from pyspark.sql import functions as F

from docloom.operators import fields as R
from docloom.operators import origins as O


def same(a, b):
    """Equal as values: numbers by value, but true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def leaves(v, path=()):
    if isinstance(v, (dict, list)):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from leaves(x, (*path, k))
    elif isinstance(v, str) and v.strip() or isinstance(v, (int, float)) and not isinstance(v, bool):
        yield path, v


def found(merged, reply, path, alone):
    """Paths in the reply at which the leaf may have been read."""
    places = [()]
    value = [(merged, reply)]
    for step in path:
        moved = []
        for (a, b), at in zip(value, places):
            if isinstance(step, str):
                if isinstance(b, dict) and step in b:
                    moved.append(((a[step], b[step]), (*at, step)))
            elif isinstance(b, list):
                moved += [((a[step], x), (*at, i)) for i, x in enumerate(b) if same(x, a[step]) and (not alone or i == step)]
        value, places = [v for v, _ in moved], [p for _, p in moved]
    return [p for (a, b), p in zip(value, places) if same(a, b)]


def test_origins_against_a_walk(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.3:
            return {rng.choice("abc"): value(depth - 1) for _ in range(rng.randrange(3))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([1, 1.0, 2, 2.5, "x", "y", " ", None, True, False])

    merged, replies, want = [], [], set()
    for k in range(120):
        said = [{n: value(2) for n in ("id", "p", "q")} for _ in range(rng.choice([1, 2, 3]))]
        base = {n: rng.choice(said)[n] if rng.random() < 0.9 else value(2) for n in ("id", "p", "q")}
        merged.append((k, json.dumps(base)))
        replies += [(k, u, json.dumps(r)) for u, r in enumerate(said)]
        for path, _ in leaves(base):
            text = json.dumps(path, separators=(",", ":"))
            if path[0] == "id":
                want.add((k, text, "inventory", None, None))
                continue
            here = {(k, text, "value", u, json.dumps(p, separators=(",", ":"))) for u, r in enumerate(said) for p in found(base, r, path, len(said) == 1)}
            want |= here or {(k, text, "unknown", None, None)}
    got = O.value_origins(spark.createDataFrame(merged, "k long, j string"), spark.createDataFrame(replies, "k long, u long, j string"), "k", "u", "j", ("id",))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_ids(spark):
    row = spark.createDataFrame([("r1", "s")], "a string, b string").select(O.record_identity(F.col("a"), F.col("b")).alias("r")).withColumn("v", O.value_identity(F.col("r"), F.lit("f"))).withColumn("u", O.digest_uuid(F.col("v"))).first()
    import hashlib
    import uuid

    assert row.r == hashlib.sha256(b'["r1","s"]').hexdigest() and row.v == hashlib.sha256(f'["{row.r}","f"]'.encode()).hexdigest()
    assert uuid.UUID(row.u).version == 5 and uuid.UUID(row.u).variant == uuid.RFC_4122 and row.u.replace("-", "")[:12] == row.v[:12]


VALUES = "seq long, record string, name string, shape string, words string, value string"


def test_registry_of_unlike_shapes(spark):
    rows = [
        (1, "r1", "title", "string", "string", "A"), (2, "r1", "year", "number", "number", "1999"), (3, "r2", "year", "string", "string", "MCM"), (4, "r2", "year (string)", "string", "string", "own"),
        (5, "r2", "part", "object:a", "object", "{}"), (6, "r3", "part", "object:b", "object", "[]"), (7, "r3", "part", "object:c", "object", "0"), (8, None, "source", "string", "string", "doc"), (9, "r3", "source", "string", "string", "mine"),
    ]
    values = spark.createDataFrame(rows, VALUES).repartition(3)
    declared = spark.createDataFrame([("part", "object:c", 0), ("title", "string", 1), ("never", "string", 2), ("title", "number", 3)], "name string, shape string, place long")
    registry = R.field_registry(values, "seq", "name", "shape", "words", declared)
    got = [(r.name, r["shape"], r["column"], r.ambiguous) for r in registry.orderBy("place").collect()]
    assert got == [
        ("part", "object:c", "part", True), ("title", "string", "title", False), ("year", "number", "year", True), ("year", "string", "year (string, 2)", True), ("year (string)", "string", "year (string)", False),
        ("part", "object:a", "part (object)", True), ("part", "object:b", "part (object, 2)", True), ("source", "string", "source", False),
    ]
    union = {(r.record, r["column"]): r.value for r in R.union_of_records(values, registry, "record", "name", "shape", "value").collect()}
    assert union["r2", "year (string, 2)"] == "MCM" and union["r1", "year"] == "1999" and union["r1", "source"] == union["r2", "source"] == "doc" and union["r3", "source"] == "mine"
    assert len(union) == 10
    assert R.field_registry(values.limit(0), "seq", "name", "shape", "words").count() == 0


def test_texts_cross_one_shuffle(spark):
    merged = spark.createDataFrame([(1, '{"id":"a","p":[1,1],"q":"x"}'), (2, '"alone"'), (None, '{"id":"b","q":2}')], "k long, j string")
    replies = spark.createDataFrame([(1, 0, '{"p":[1,2]}'), (1, 1, "no JSON"), (2, 0, '"alone"'), (None, 0, '{"q":2}')], "k long, u long, j string")
    got = O.value_origins(merged, replies, "k", "u", "j", ("id",))
    want = {
        (1, '["id"]', "inventory", None, None), (1, '["p",0]', "value", 0, '["p",0]'), (1, '["p",1]', "value", 0, '["p",0]'), (1, '["q"]', "unknown", None, None), (2, "[]", "value", 0, "[]"),
        (None, '["id"]', "inventory", None, None), (None, '["q"]', "unknown", None, None),
    }
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan and "docloom-" not in got._jdf.queryExecution().executedPlan().toString()
