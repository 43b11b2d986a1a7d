import hashlib
import random

from docloom.llm import substrings as S


def brute(docs, k=13):
    """{doc_id: (n_words, n_removed, kept)} from (doc_id, text) with unique ids."""
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][a : a + k]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in brute(docs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.op2_substrings(spark, sf).collect()} == want


def test_random_overlaps(spark):
    rng = random.Random(3)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(8, 40))] for _ in range(12)]
    docs = [(i * 7 % 61, " ".join(w for p in rng.choices(pool, k=rng.randint(1, 5)) for w in p)) for i in range(60)]
    docs += [(1000, "same " * 500), (1001, "same " * 300), (1002, "x " + "same " * 14 + "y")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_edges(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = [(1, text, "e"), (1, text, "e"), (2, text, "e"), (3, None, "e"), (4, "", None), (5, "one\u00a0two\tthree", "e"), (None, text, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edge string").selectExpr("*", "1 AS anchor", "2 AS pos", "true AS own")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in S.dedup_substrings(df).collect())
    assert got == [("1", 20, 0), ("1", 20, 0), ("2", 20, 20), ("3", 0, 0), ("4", 0, 0), ("5", 2, 0), ("None", 20, 0)]
    assert S.dedup_substrings(df.limit(0)).count() == 0
