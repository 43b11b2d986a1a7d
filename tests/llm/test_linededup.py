import hashlib
import random

import numpy as np
import pytest

from docloom.llm import common
from docloom.llm import linededup as L
from docloom.operators import graph
from tests.test_queries import canon, duck

LONG = "This very line is long enough to be compared, as it has over forty letters"


def brute(docs, least=40, most=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < most or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_sql(spark, sf):
    got = L.op12_linededup(spark, sf)
    cur = duck(sf).execute(L.ORACLES["op12_linededup"])
    names = [d[0] for d in cur.description]
    want = canon(cur.fetchall(), names)
    assert sum(x[sorted(names).index("n_dropped")] for x in want)
    assert canon([tuple(r) for r in got.collect()], got.columns) == want


@pytest.mark.parametrize("min_docs", [2, 3, 5])
def test_random_lines(spark, min_docs):
    rng = random.Random(min_docs)
    pool = [f"{LONG} number {i}" for i in range(12)] + ["short", "", "é" * 39, "é" * 40, " \t" + LONG.upper() + "\r", LONG]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(6)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, L.dedup_lines(frame, min_docs=min_docs).collect()), key=repr)
    assert got == brute(docs, most=min_docs)


def test_edges(spark):
    long_text = "\n".join(f"{LONG} {i}" for i in range(20_000))
    docs = [(1, None), (2, ""), (3, LONG), (3, LONG + "\n" + LONG), (4, LONG), (None, LONG), (None, LONG), (5, LONG + "\n\n" + LONG), (6, long_text), (7, long_text), (8, "a \n\x1c" + LONG)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS gone", "'x' AS digest", "2 AS block", "3 AS bits")
    for least in (2, 3, 4):
        got = sorted(map(tuple, L.dedup_lines(frame, min_docs=least).collect()), key=repr)
        assert got == brute(docs, most=least)
    empty = L.dedup_lines(frame.limit(0))
    assert empty.columns == ["doc_id", "n_lines", "n_dropped", "kept"] and empty.count() == 0


def test_hot_keys_are_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 5)
    monkeypatch.setattr(graph, "SHARE", 10)
    docs = [(i, LONG + "\n" + f"{LONG} {i % 9}") for i in range(60)]
    got = sorted(map(tuple, L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(docs)


def test_twice_filter_misses_no_repeat():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 300, 100).astype(np.uint64) * np.uint64(977) for _ in range(4)]
    state = np.zeros(common.SLOTS_IN_ROW, np.uint8)
    for p in parts:
        batch = common.slot_rows(p, 2)
        assert batch.column(0).to_pylist() == [0]
        L._seen(state, np.frombuffer(batch.column(1)[0].as_py(), np.uint32), np.frombuffer(batch.column(2)[0].as_py(), np.uint8))
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    assert (state[values.astype(int)] & L.ONCE > 0).all()
    assert ((state[values.astype(int)] & L.TWICE > 0) == (n > 1)).all()


def test_digest_of_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(i, hashlib.sha256(k.encode()).hexdigest()) for i, _, _, k in brute([tuple(r) for r in docs])}
    assert {(r.doc_id, r.kept_sha256) for r in L.op12_linededup(spark, sf).collect()} == want
