import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import langid as L


def test_forward_backward_against_all_paths(monkeypatch):
    monkeypatch.setattr(L, "_BLOCK", 3)
    rng = np.random.default_rng(2)
    sizes, s = np.array([1, 4, 7]), 3
    scores, trans = rng.normal(size=(12, s)), rng.normal(size=(s, s))
    got, at = L.forward_backward(scores, sizes, trans), 0
    for n in sizes:
        want, e = np.zeros((n, s)), scores[at : at + n]
        for path in itertools.product(range(s), repeat=int(n)):
            p = np.exp(trans[:, path[0]]).sum() * np.exp(sum(e[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += p
        assert got[at : at + n] == pytest.approx(want / want.sum(1, keepdims=True))
        at += n


def log_likelihood(scores, y, trans):
    """Of one document, by all paths."""
    n, s = scores.shape
    start = lambda k: np.log(np.exp(trans[:, k]).sum())
    value = lambda path: start(path[0]) + sum(scores[i, k] for i, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
    return value(y) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(s), repeat=n)))


def test_pair_marginals_against_all_paths(monkeypatch):
    monkeypatch.setattr(L, "_BLOCK", 2)
    rng = np.random.default_rng(3)
    sizes, s = np.array([5, 1, 4]), 3
    scores, trans = rng.normal(size=(10, s)) * 2, rng.normal(size=(s, s)) * 2
    p, i, pair = L.with_pairs(scores, sizes, trans)
    assert i.tolist() == [0, 1, 2, 3, 6, 7, 8]
    for start, n in ((0, 5), (6, 4)):
        want, e = np.zeros((n - 1, s, s)), scores[start : start + n]
        for path in itertools.product(range(s), repeat=n):
            w = np.exp(trans[:, path[0]]).sum() * np.exp(sum(e[j, y] for j, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for j in range(n - 1):
                want[j, path[j], path[j + 1]] += w
        got = pair[(i >= start) & (i < start + n)]
        assert got == pytest.approx(want / want.sum((1, 2), keepdims=True))
        assert got.sum(2) == pytest.approx(p[start : start + n - 1]) and got.sum(1) == pytest.approx(p[start + 1 : start + n])


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    n, s, d = 5, 3, 1e-6
    scores, trans, y = rng.normal(size=(n, s)), rng.normal(size=(s, s)), rng.integers(0, 3, n)
    p, i, pair = L.with_pairs(scores, np.array([n]), trans)
    for k in range(n):
        for a in range(s):
            up, down = scores.copy(), scores.copy()
            up[k, a] += d
            down[k, a] -= d
            assert (y[k] == a) - p[k, a] == pytest.approx((log_likelihood(up, y, trans) - log_likelihood(down, y, trans)) / 2 / d, abs=1e-6)
    # the first label's weight does not depend on single transitions as these are measured between words
    counted = np.bincount(y[i] * s + y[i + 1], minlength=s * s).reshape(s, s) - pair.sum(0)
    start = np.exp(trans) / np.exp(trans).sum(0)
    first = start * (np.eye(s)[y[0]] - p[0])[None]
    for a in range(s):
        for b in range(s):
            up, down = trans.copy(), trans.copy()
            up[a, b] += d
            down[a, b] -= d
            assert counted[a, b] + first[a, b] == pytest.approx((log_likelihood(scores, y, up) - log_likelihood(scores, y, down)) / 2 / d, abs=1e-6)


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.op9_crf(spark, sf).collect()
    assert {r.doc_id for r in got} == set(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    asked = [r for r in got if r.held_out and lang[r.doc_id][0] and any(c.isalpha() for c in lang[r.doc_id][1] or "")]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in asked) >= 0.97 * len(asked)


def test_code_switched_text(spark):
    a, b = ["alpha beta gamma", "gamma delta alpha"], ["один два три", "три четыре два"]
    rows = [(i, " ".join(a * 5), "aa") for i in range(20)] + [(100 + i, " ".join(b * 5), "bb") for i in range(20)]
    rows += [(500, "alpha beta gamma delta три два один alpha", None), (501, None, "aa"), (502, "", "bb"), (503, "12 34 !!", "aa"), (None, "beta", "aa"), (504, "beta " * 40_000, None), (1, "alpha", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS fold", "2 AS h", "'w' AS words", "0 AS score")
    got = L.identify_languages(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[500].lang_pred == "aa" and by[500].switches == 2
    assert [(by[i].lang_pred, by[i].score) for i in (501, 502, 503)] == [("und", 0.0)] * 3
    assert by[504].lang_pred == "aa" and by[None].lang_pred == "aa" and not by[None].held_out
    assert L.identify_languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify_languages(df.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}
    assert L.keep_identified(df).where("doc_id in (501, 502, 503)").count() == 0


def test_texts_are_labelled_and_sent_on_in_small_parts(monkeypatch):
    words = []
    monkeypatch.setattr(L, "fit", lambda *a: (None, (["a", "b"], np.ones((L.BUCKETS, 2), np.float32) * [9, 0], np.zeros((2, 2)))))
    monkeypatch.setattr(L, "forward_backward", lambda scores, sizes, trans, f=L.forward_backward: (words.append(len(scores)), f(scores, sizes, trans))[1])

    class Docs:
        columns, schema = ["text"], None

        def mapInArrow(self, run, schema):
            return run

    texts = ["word " * 100] * 2500 + ["1 2"]
    got = list(L.keep_identified(Docs())([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    assert [b.num_rows for b in got] == [1024, 1024, 452] and sum(words) == 250_000
    assert max(words) <= L._GROUP_WORDS + 100 < 30_000
