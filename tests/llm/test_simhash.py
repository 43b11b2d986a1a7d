import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import simhash as S


def brute_components(fps, max_bits):
    """fps: list of (doc_id, fingerprint). {doc_id: smallest reachable}"""
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_by_hand():
    text = "The cat SAT on the mat the cat sat on the mat again"
    w = "the cat sat on the mat the cat sat on the mat again".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert S.fingerprint(text.encode()) & (1 << 64) - 1 == want
    assert S.fingerprint(b"One two") & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two", 42)
    assert S.fingerprint(None) == S.fingerprint(b" \n") == 0


def test_long_text_in_steps(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000)).encode()
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "_STEP", 64)
    assert S.fingerprint(text) == whole


@pytest.mark.parametrize("hot", [512, 2])
def test_components_against_brute_force(spark, hot):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = []
    for i in range(150):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        fps.append((i, x - (1 << 64) if x >> 63 else x))
    nodes = spark.createDataFrame([(x,) for _, x in fps], "fp long").distinct()
    link = S.links(nodes, 4, hot)
    comp = {r.node: r.component for r in S.components(link).collect()}
    want = brute_components(fps, 4)
    got = {}
    for i, x in fps:
        got.setdefault(comp.get(x, x), []).append(i)
    assert {min(v): sorted(v) for v in got.values()} == {k: [i for i in want if want[i] == k] for k in set(want.values())}


@pytest.mark.parametrize("m,radius", [(5, 0), (3, 1), (2, 2)])
def test_every_plan_finds_all_pairs(spark, monkeypatch, m, radius):
    monkeypatch.setattr(S, "plan_segments", lambda n, k: m)
    rng = random.Random(m)
    base = rng.getrandbits(64)
    fps = set()
    for _ in range(40):
        x = base
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        fps.add(x - (1 << 64) if x >> 63 else x)
    got = {frozenset((r.src, r.dst)) for r in S.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert got == want


def test_plan_follows_size():
    assert S.plan_segments(10, 4) > S.plan_segments(10**9, 4)


def test_edges(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, None, "y"), (3, "", None), (None, "a b c d e", "z"), (5, "q r s t u v", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("clash"))
    got = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in S.near_duplicates(docs).collect()), key=str)
    assert len(got) == 6
    by = dict((i, c) for i, c, _ in got)
    assert by[1] == 1 and by[None] == 1 and by[2] == by[3] == 2 and by[5] == 5
    assert {f for i, _, f in got if i == 2} == {"0" * 16}
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op10_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, S.fingerprint(r.text.encode() if r.text else None)) for r in docs]
    x = np.array([f for _, f in fps], np.int64).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 4
    label = np.array([i for i, _ in fps])
    while True:
        new = np.where(near, label[None], label.max()).min(1)
        if (new == label).all():
            break
        label = new
    assert got == {i: (f"{int(f) & (1 << 64) - 1:016x}", int(c)) for (i, f), c in zip(fps, label)}


@pytest.mark.parametrize("hot", [512, 3])
def test_exploded_rows_are_not_sent_to_all_tasks(spark, hot):
    """Spark sizes them as the fingerprints before the explode, so no join of them is left to that size."""
    rng = random.Random(4)
    fps = [rng.getrandbits(62) ^ (1 << 63 >> rng.randrange(3)) - (1 << 62) for _ in range(50)]
    fps += [fps[0] ^ 1 << i for i in range(20)]
    nodes = spark.createDataFrame([(x,) for x in {*fps}], "fp long")
    plan = S.links(nodes, 4, hot)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x]
    assert len(joins) == (1 if hot == 512 else 2) and all("strategy=merge" in x for x in joins)
