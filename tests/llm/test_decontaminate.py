import re

import numpy as np

from docloom.llm import decontaminate as D

ITEM = "A farmer named Peter sells 12 apples and 30 pears at the market every single morning before the rain."
OTHER = "A farmer named Laura sells 75 apples and 44 pears at the market every single morning before the rain."
MIXED = "A farmer named Laura sells 75 apples and 75 pears at the market every single morning before the rain."
CLEAN = "The market opens every morning and many people come to buy apples, pears and bread before they go to work."


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS slots", "'x' AS item_id"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS width")


def test_kinds(spark):
    d, b = frames(spark, [(1, f"Intro words here. {ITEM} And more."), (2, OTHER), (3, MIXED), (4, CLEAN)], [(7, ITEM)])
    for max_sent in (D.MAX_SENT, 0):
        got = {r.doc_id: r.kind for r in D.find_leaks(d, b, max_sent=max_sent).collect()}
        assert got == {1: "exact", 2: "reparameterised"}


def test_windows_against_one_by_one():
    vocab, rng = D.Vocabulary(), np.random.default_rng(1)
    texts = [" ".join(rng.choice(["Ann", "12", "km", "the", "a.", "cat", "Ran", "--", "x9"], rng.integers(0, 40))).encode() for _ in range(30)] + [None, b""]
    h, slot, _, doc = vocab.template(texts)
    got = {(w, int(doc[a]), int(x)) for w, at, xs in D.windows(h, slot, doc, [5, 8], 4) for a, x in zip(at, xs)}
    want = set()
    for i, t in enumerate(texts):
        g, s, _, one = vocab.template([t])
        assert (g == h[doc == i]).all() and (s == slot[doc == i]).all()
        want |= {(w, i, int(x)) for w, at, xs in D.windows(g, s, one, [5, 8], 4) for x in xs}
    assert got == want and want
    known = D.Known(np.array(sorted({x for _, _, x in want})[::2], np.uint64))
    assert {x for w, at, xs in D.windows(h, slot, doc, [5, 8], 4, known) for x in xs.tolist()} == set(known.sorted.tolist())


def test_verbatim_passages_are_found(spark, sf):
    """Every document that holds ten consecutive words of an item, with few slots among them, is found."""
    plain = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 14]) for _, w in items for i in range(len(w) - 13)}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id for r in docs for w in [plain(r.text)] if any(tuple(w[i : i + 14]) in grams for i in range(len(w) - 13))}
    assert want and want <= {r.doc_id for r in D.op8_templates(spark, sf).select("doc_id").collect()}


def test_edges(spark):
    d, b = frames(spark, [(1, None), (2, ""), (3, ITEM), (3, ITEM), (None, ITEM), (6, "w " * 60_000 + ITEM)], [(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "four words are few")])
    assert sorted((str(r.doc_id), r.item_id) for r in D.find_leaks(d, b).collect()) == [("3", 1), ("6", 1), ("None", 1)]
    assert D.find_leaks(d.limit(0), b).count() == 0 and D.find_leaks(d, b.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in D.drop_leaks(d, b).collect()) == ["1", "2", "None"]


def test_verbatim_copies_of_any_kind_are_found(spark):
    """Items of many slots or few words, word for word in a document; with other values they are no match."""
    items = ["What is 12 + 7 - 3 * 4?", "A train travels 60 km in 2 hours and 90 km in 3.", "Name the largest planet.", "Anna met Paul, Laura, Peter, Hans, Karl, Stefan, Juan, Bob and Emma there."]
    docs = [(i, f"Some words before, {x} And after.") for i, x in enumerate(items)] + [(8, "Before. What is 15 + 9 - 2 * 6? After."), (9, CLEAN)]
    d, b = frames(spark, docs, list(enumerate(items)))
    for max_sent in (D.MAX_SENT, 0):
        got = sorted((r.doc_id, r.item_id, r.kind) for r in D.find_leaks(d, b, max_sent=max_sent).collect())
        assert got == [(i, i, "exact") for i in range(4)]


def typed(text):
    """(template word, whether a slot, plain word) of each word, one after the other."""
    out, initial = [], True
    for line in (text or "").split("\n"):
        initial, before = True, None if not out else out[-1]
        for raw in line.split():
            plain = re.sub(r"[\W_]+", "", raw)
            if plain:
                digits = sum(c.isdigit() for c in plain)
                number = 2 * digits >= len(plain) and digits > 0 or raw[0].isdigit()
                unit = not number and plain.lower() in D.UNITS and before is not None and before[0] == "<number>"
                name = not number and not unit and plain.lower() not in D.UNITS and plain[0].isupper() and not plain.isupper() and not initial
                before = ("<number>" if number else "<unit>" if unit else "<name>" if name else plain.lower(), number or unit or name, plain.lower())
                out.append(before)
            if plain:
                initial = False
            if raw.rstrip("\"')]").endswith((".", "!", "?", ":")):
                initial = True
    return out


def plain_leaks(doc, item, width=D.WINDOW, least=D.MIN_LITERALS):
    """(windows, kind) of the best alignment of a document with an item, or None; all windows against all."""
    d, t = typed(doc), typed(item)
    w = min(width, len(t))
    if not w:
        return None
    lines = {}
    for plain in (False, True):
        for a in range(len(t) - w + 1):
            mine = t[a : a + w]
            literals = sum(not s for _, s, _ in mine)
            few = literals < min(least, w - 1)
            if (not plain and (few or w < D.MIN_ITEM)) or (plain and len(t) > width and not few):
                continue
            for b in range(len(d) - w + 1):
                other = d[b : b + w]
                same = [x[2] for x in mine] == [x[2] for x in other] if plain else [x[:2] for x in mine] == [x[:2] for x in other]
                if same:
                    pairs = {(x[2], y[2]) for x, y in zip(mine, other) if x[1]}
                    at, seen = lines.setdefault((plain, b - a), (set(), set()))
                    at.add(b)
                    seen |= {(p, p) for p, _ in pairs} if plain else pairs
    good = []
    for at, pairs in lines.values():
        changed = sum(p != q for p, q in pairs)
        if not changed or len({p for p, _ in pairs}) == len({q for _, q in pairs}) == len(pairs):
            good.append((len(at), -changed, -min(at)))
    best = max(good, default=None)
    return best and (best[0], "exact" if not best[1] else "reparameterised")


def test_all_pairs_against_a_plain_search(spark):
    """Every pair of many texts of few words, with values changed one to one or not, sentences begun anew, marks and units."""
    rng = np.random.default_rng(12)
    words = ["a", "farmer", "sells", "Ann", "Bob", "12", "30", "km", "and", "the", "of", "in", "one", "two", "--", "rain.", "Why?", "TV", "x9"]
    items = [" ".join(rng.choice(words, n)) for n in (3, 4, 6, 9, 14, 18, 25, 30) for _ in range(3)] + [ITEM]
    docs = []
    for i in range(150):
        base = items[i % len(items)].split()
        change = {x: str(rng.choice([x, x, *{"Ann": ["Cleo", "Dan"], "Bob": ["Dan", "Eve"], "12": ["77", "5"], "30": ["5", "9.5"], "km": ["miles"]}.get(x, [])])) for x in set(base)}
        body = [change[x] if rng.random() < 0.97 else str(rng.choice(words)) for x in base]
        docs.append(" ".join([*rng.choice(words, rng.integers(0, 6)), *body, *rng.choice(words, rng.integers(0, 6))]).replace("Why? ", "Why?\n"))
    want = {(i, j): found for i, doc in enumerate(docs) for j, item in enumerate(items) if (found := plain_leaks(doc, item))}
    d, b = frames(spark, list(enumerate(docs)), list(enumerate(items)))
    got = {(r.doc_id, r.item_id): (r.windows, r.kind) for r in D.find_leaks(d, b).collect()}
    assert got == want and {k for _, k in want.values()} == {"exact", "reparameterised"} and len(want) < len(docs) * len(items) / 2
