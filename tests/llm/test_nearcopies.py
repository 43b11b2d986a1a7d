import random
import re

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
import pytest
from docloom.llm import common, nearcopies as J, simhash
from docloom.operators import graph


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(rows):
    found = {i: sets_of(t) for i, t in rows}
    label = {i: i for i in found}
    changed = True
    while changed:
        changed = False
        for i, a in found.items():
            for j, b in found.items():
                if label[j] < label[i] and 5 * len(a & b) >= 4 * len(a | b):
                    label[i], changed = label[j], True
    return label


def edited(rng, n=60, kinds=10):
    """Copies of a few texts with up to 4 words changed, so similarities lie on both sides of 0.8."""
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(120)] for _ in range(kinds)]
    for i in range(n):
        words = list(rng.choice(base))
        for at in rng.sample(range(120), rng.randint(0, 4)):
            words[at] = f"x{rng.random()}"
        yield i, " ".join(words)


def test_components_against_brute_force(spark):
    rows = [*edited(random.Random(3)), (900, "few words"), (901, "Few  words"), (902, None), (903, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.near_copies(df).collect()} == brute(rows)


@pytest.mark.parametrize("batch", [10000, 7])
def test_one_large_group(spark, batch):
    """All texts in a few large buckets, met within and across batches."""
    rows = list(edited(random.Random(4), 150, 2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.doc_id: r.component_id for r in J.near_copies(df).collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 2)
    monkeypatch.setattr(graph, "SHARE", 10**9)
    monkeypatch.setattr(graph, "HUB_LINKS", 2)
    rows = [*edited(random.Random(5), 60, 3), *((1000 + i, "just the same words here again") for i in range(20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.near_copies(df).collect()} == brute(rows)


@pytest.mark.parametrize("n", [1 << 23, 1 << 30])
def test_every_plan_finds_near_ones(spark, monkeypatch, n):
    at = J.plan(n)
    monkeypatch.setattr(J, "plan", lambda _: at)
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    rows = [(i, " ".join([*base[: 10 * i], f"x{i}", *base[10 * i + 1 :]])) for i in range(10)]
    assert {r.component_id for r in J.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_sketch_in_steps_and_by_hand(monkeypatch):
    found = J.shingles(" ".join(str(i) for i in range(300)).encode())
    words, margin = J.sketch(found)
    monkeypatch.setattr(J, "_STEP", 7)
    assert (J.sketch(found)[0] == words).all() and (J.sketch(found)[1] == margin).all()
    one, sure = J.sketch(found[:1])
    assert (sure == 1).all() and len(one) == J.BITS // 64
    assert 0.3 < np.unpackbits(one.view(np.uint8)).mean() < 0.7


def test_very_long_text(spark):
    words = [f"w{i % 9973}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:500], "new", *words[501:]])), (3, " ".join(words[:20_000]))]
    got = {r.doc_id: r.component_id for r in J.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == 1 and got == brute(rows)


def test_stage_finds_copies_beyond_four_bits(spark, sf):
    """Copies of similarity 0.8 or more whose op10 fingerprints lie more than four bits apart."""
    rng = random.Random(1)
    a = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    b = [*a[:40], "new", *a[41:]]
    assert (simhash.fingerprint(" ".join(a).encode()) ^ simhash.fingerprint(" ".join(b).encode())).bit_count() > 4
    docs = common.table(spark, sf, "documents").limit(0)
    given = spark.createDataFrame([(7, " ".join(b)), (3, " ".join(a)), (9, "another text of no kin at all")], "doc_id long, text string").selectExpr(*(c if c in ("doc_id", "text") else f"null AS {c}" for c in docs.columns))
    assert sorted(r.doc_id for r in P.near_duplicates(spark, given, sf).collect()) == [3, 9]


def test_edges(spark):
    text = "a b c d e f"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, text, "y"), (None, text, "z"), (1, "quite another text", "v"), (5, None, "u")], "doc_id long, text string, th string")
    got = sorted((str(r.doc_id), str(r.text)) for r in J.keep_one_of_each(df).collect())
    assert got == [("1", text), ("1", "quite another text"), ("5", "None"), ("None", text)]
    assert J.keep_one_of_each(df.limit(0)).count() == 0 and J.keep_one_of_each(df).columns == df.columns


def test_without_by_filter(spark, monkeypatch):
    df = spark.range(5000).selectExpr("if(id % 11 = 0, null, id) AS doc_id", "id AS other", "'x' AS b")
    gone = common.materialize(spark.range(0, 5000, 7).selectExpr("id AS doc_id"))
    want = sorted(i for i in range(5000) if i % 11 == 0 or i % 7)
    for size in (common.FILTER_BITS, 1 << 15):
        monkeypatch.setattr(common, "FILTER_BITS", size)
        got = common.without(df, gone, [df["doc_id"].cast("long")], ["doc_id"])
        assert got.columns == df.columns and sorted(r.other for r in got.collect()) == want
    assert common.without(df, gone.limit(0), [df["doc_id"].cast("long")], ["doc_id"]).count() == 5000


def test_blocks_of_a_bucket_against_all_pairs(spark):
    """Block sizes don't change what is found; a bucket of one member and equal components find nothing."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (4, J.BITS), np.uint8)
    rows = []
    for i in range(60):
        bits = base[i % 4] ^ (rng.random(J.BITS) < (0.05 if i % 3 else 0.13))
        rows.append((i, [int(x) for x in np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)], 80 + i % 30))
    nodes = spark.createDataFrame(rows, "node long, bits array<long>, n int")
    members = [(b, i, i // 5 * 5) for b in (1, 2) for i in range(60) if b == 1 or i % 2] + [(3, 7, 5)]
    want = set()
    for b, i, ci in members:
        for c, j, cj in members:
            x, y = rows[i][1], rows[j][1]
            far = [((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y)]
            if b == c and i < j and ci != cj and min(rows[i][2], rows[j][2]) >= 0.8 * max(rows[i][2], rows[j][2]) and far[0] <= J.MOST_LEAD and sum(far) <= J.MOST_BITS:
                want.add((i, j))
    given = spark.createDataFrame(members, "bucket long, node long, component long")
    assert len(want) > 50
    for block in (4, 1024):
        assert sorted(map(tuple, J._meet_in_blocks(given, nodes, block).collect())) == sorted(want)
    assert J._meet_in_blocks(given.limit(0), nodes).isEmpty()


def test_members_apart_against_plain_counting(spark, monkeypatch):
    """The members of buckets of more than two with several components, made without a join by bucket."""
    rng = random.Random(8)
    rows = lambda n, names: [tuple(rng.randrange(k) for _, k in names) for _ in range(n)]
    names = [("bucket", 40), ("node", 30), ("first", 30)]
    met, held = rows(40, names), rows(30, names)
    comp = {i: i % 3 for i in range(0, 30, 2)}
    buckets = {}
    for b, x, y in met + held:
        buckets.setdefault(b, set()).update((x, y))
    want = sorted((b, i, comp.get(i, i)) for b, m in buckets.items() if len(m) > 2 and len({comp.get(i, i) for i in m}) > 1 for i in m)
    make = lambda x: spark.createDataFrame(x, "bucket long, node long, first long")
    out = J._members_apart(make(met), make(held), spark.createDataFrame(list(comp.items()), "node long, component long"))
    assert sorted(map(tuple, out.collect())) == want and 0 < len(want) < len(buckets) * 30
    assert not re.search(r"Join \[bucket", out._jdf.queryExecution().simpleString()) and "Join" in out._jdf.queryExecution().simpleString()


def test_a_small_graph_takes_no_rounds(spark, monkeypatch):
    """It is written once, and the rounds of a larger one give the same."""
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(200), rng.randrange(200)) for _ in range(150)], "src long, dst long")
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or common.materialize(df))
    got = sorted(map(tuple, graph.components(edges).collect()))
    assert len(written) == 1
    monkeypatch.setattr(graph, "HUB_LINKS", 100)
    assert sorted(map(tuple, graph.components(edges).collect())) == got and len(written) > 3 and len(got) > 100
    assert graph.components(edges.limit(0)).isEmpty()


def test_clusters_in_blocks_against_all_pairs(spark):
    """Texts that are all near, some similar: block sizes don't change what is joined, and links are few."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(50):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 3, 4, 5])):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words).encode())
    sets = [J.shingles(t) for t in texts]
    nodes = spark.createDataFrame([(i, [int(w) for w in J.sketch(s)[0].view(np.int64)], len(s)) for i, s in enumerate(sets)], "node long, bits array<long>, n int")
    found = spark.createDataFrame([(i, [int(x) for x in s.view(np.int64)]) for i, s in enumerate(sets)], "node long, found array<long>")
    members = spark.createDataFrame([(c, 50, i, i // 3 * 3) for c in (0, 1) for i in range(50)], "cluster long, k long, node long, component long")
    like = lambda i, j: (shared := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - shared)

    def groups(links):
        label = {i: i // 3 * 3 for i in range(50)}
        for i, j in links:
            a, b = label[i], label[j]
            label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
        return label

    want = groups((i, j) for i in range(50) for j in range(i) if like(i, j))
    assert 1 < len(set(want.values())) < 17
    for block in (7, 512):
        links = [tuple(r) for r in J._similar_in_blocks(members, nodes, found, block).collect()]
        assert all(like(i, j) for i, j in links) and groups(links) == want
    whole = J._shared(sets[:20], sets[20:])
    assert (whole == [[len(np.intersect1d(x, y)) for y in sets[20:]] for x in sets[:20]]).all()


def test_a_large_group_meets_few_at_once(spark, monkeypatch):
    """In a group of near copies complete fingerprints are compared for few pairs a text; how many come first changes nothing."""
    rows = list(edited(random.Random(11), 400, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, met, close = brute(rows), [], J._close
    monkeypatch.setattr(J, "_close", lambda pairs, nodes: met.append(pairs.distinct().count()) or close(pairs, nodes))
    assert {r.doc_id: r.component_id for r in J.near_copies(df).collect()} == want
    assert 0 < sum(met) <= 12 * len(rows)
    monkeypatch.setattr(J, "FIRSTS", 1)
    assert {r.doc_id: r.component_id for r in J.near_copies(df).collect()} == want and len(met) > 2


@pytest.mark.parametrize("later", [False, True])
def test_segment_values_are_sent_in_small_batches(monkeypatch, later):
    rng = np.random.default_rng(5)
    found = [rng.integers(0, 1 << 62, 40, dtype=np.uint64) for _ in range(30)] * 2
    sketches = [J.sketch(x) for x in found]
    low = [np.argsort(m[:960].reshape(40, 24), 1, kind="stable")[:, :2].astype(np.uint8).tobytes() for _, m in sketches]
    given = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([w for w, _ in sketches], pa.list_(pa.int64())), pa.array(low), pa.array([40] * 60, pa.int32())], names=["node", "bits", "low", "n"])
    run, _ = J._buckets(24, 2, later)
    whole = pa.Table.from_batches(run([given]))
    monkeypatch.setattr(J, "_SENT", 500)
    parts = list(run([given]))
    assert max(b.num_rows for b in parts) == 500 and pa.Table.from_batches(parts).combine_chunks() == whole.combine_chunks()
    assert len(whole) == 4800 and whole.num_rows > 500  # two equal texts have each of 30 * 160 values


def test_partitions_of_segment_values():
    assert J._partitions(0, 12) == 12 and J._partitions(6_000_000, 12) == 24  # 500,000 a task before
    assert J._partitions(10**9, 12) == 48 and J._partitions(10**6, 211) == 211
