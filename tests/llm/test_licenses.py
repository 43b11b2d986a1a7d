import re

from docloom.llm import licenses as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_on_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.op4_licenses(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_and_edges(spark):
    rows = [(1, "foo bar Released under the MIT License. baz"), (2, "the mit of a license"), (3, "CC BY cc-by ALL rights\nreserved"), (4, None), (5, ""), (6, "x " * 50_000 + "general public license"), (6, "x " * 50_000 + "general public license"), (None, "cc by"), (8, "cc bys all rights")]
    rows += [(100 + i, "plain words of a text") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS labels", "'s' AS score")
    got = L.scan_licenses(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].labels == "mit" and by[1].n_base == 0 and 0 < by[1].score <= 1 and by[2].labels == ""
    assert by[3].base_labels == "cc-by,reserved" and by[3].n_base == 3 and (by[3].first_word, by[3].last_word) == (0, 4)
    assert by[4].n_words == by[5].n_words == 0 and by[4].first_word is None and by[6].first_word == 50_000 and by[None].n_base == 1 and by[8].n_base == 0
    assert L.scan_licenses(df.limit(0)).count() == 0


def plainly(words, index, min_share):
    """Every template laid at every place of the text, word by word."""
    out = {}
    for k, (label, text, phrases) in enumerate(index.templates):
        spots = {i: weight for w, posts in index.postings.items() for t, i, weight in posts if t == k}
        for at in range(-len(text), len(words)):
            share = min(1.0, sum(weight for i, weight in spots.items() if 0 <= at + i < len(words) and words[at + i] == text[i]) / index.mass[k])
            lo, hi = max(0, at - 2), at + len(text) + 2
            if share >= min_share and all(any(words[j : j + len(p)] == p for j in range(lo, min(hi, len(words)) - len(p) + 1)) for p in phrases):
                out[label] = max(out.get(label, 0), share)
    return out


def test_labels_and_scores_on_whole_table(spark, sf):
    """Every document that has a rare word of a template, and edited copies of every template, against a plain search."""
    import random

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng, made = random.Random(4), []
    for k, (_, text, _) in enumerate(L.TEMPLATES):
        words = text.split()
        for n in range(3):
            cut = list(words)
            for _ in range(n * 2):
                at = rng.randrange(len(cut))
                cut[at : at + 1] = rng.choice([["other"], [], [cut[at], "more"]])
            made.append((10**6 + 10 * k + n, "some words before " + " ".join(cut) + " and after"))
    whole = docs.union(spark.createDataFrame(made, "doc_id long, text string"))
    n, frequency = L.word_frequency(whole, frozenset(w for _, t, _ in L.TEMPLATES for w in L.tokens(t.encode())))
    index = L.Index(L.TEMPLATES, n, frequency)
    got = {r.doc_id: r for r in L.scan_licenses(whole).collect()}
    exact = 0
    for r in whole.collect():
        words = L.tokens((r.text or "").encode())
        want = plainly(words, index, L.MIN_SHARE) if not index.words.isdisjoint(words) and len(words) < 3000 else None
        if want is not None:
            base = set(filter(None, got[r.doc_id].base_labels.split(",")))
            assert set(filter(None, got[r.doc_id].labels.split(","))) == base | set(want), r.doc_id
            assert got[r.doc_id].score == (1.0 if base else max(want.values(), default=0.0)) or abs(got[r.doc_id].score - max(want.values(), default=0)) < 1e-9
        if r.doc_id >= 10**6 and r.doc_id % 10 == 0:
            exact += L.TEMPLATES[(r.doc_id - 10**6) // 10][0] in got[r.doc_id].labels.split(",")
    assert exact == len(L.TEMPLATES)
