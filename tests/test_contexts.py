import random

import pytest

from docloom.operators import contexts as C

LABELS = ["Text", "Text", "Text", "Title", "SectionHeader", "PageHeader", "PageFooter", "Caption", "Footnote", "Table", None]


def may_end(labels, i):
    """Whether a part may end before passage i: no heading is left without its body, no table without what is beside it."""
    back = [x for x in labels[:i] if x not in C.FURNITURE]
    if back and back[-1] in C.HEADINGS:
        return False
    aside = lambda x: x in C.FURNITURE + C.BESIDE_TABLES
    first = i - 1
    while first >= 0 and aside(labels[first]):
        first -= 1
    last = i
    while last < len(labels) and aside(labels[last]):
        last += 1
    tables = [t for t in (first, last) if 0 <= t < len(labels) and labels[t] == "Table"]
    return not any(t == first and aside(labels[i]) or t == last and aside(labels[i - 1]) for t in tables)


def parts(passages, most, overlap, structural):
    """All cuts at once: (context, pos, part)."""
    labels, n, out, at, heading, number = [p[2] for p in passages], len(passages), [], 0, None, 0
    cost = lambda xs: sum(passages[i][1] for i in xs)
    while at < n:
        if labels[at] in C.HEADINGS:
            heading = None
        head = {heading} - {None} if structural else set()
        ends = [e for e in range(at + 1, n + 1) if e == n or not structural or may_end(labels, e)]
        fits = [e for e in ends if cost(head | set(range(at, e))) <= most]
        end = fits[-1] if fits else ends[0]
        if structural and end < n:
            end = ([e for e in ends if e <= end and labels[e] in C.HEADINGS] or [end])[-1]
        extra = list(range(max(0, at - overlap), at))
        while extra and cost(head | set(extra) | set(range(at, end))) > most:
            extra = extra[1:]
        number += 1
        out += [(number, passages[i][0], "heading") for i in head - set(extra)] + [(number, passages[i][0], "overlap") for i in extra] + [(number, passages[i][0], "primary") for i in range(at, end)]
        heading = max((i for i in range(at, end) if labels[i] in C.HEADINGS), default=heading)
        at = end
    return out


@pytest.mark.parametrize("overlap,structural", [(0, True), (2, True), (1, False)])
def test_contexts(spark, overlap, structural):
    rng = random.Random(overlap)
    docs = {d: [(3 * i, rng.randrange(0, 30), rng.choice(LABELS)) for i in range(rng.randrange(1, 30))] for d in range(150)}
    rows = [(d, *p) for d, ps in docs.items() for p in ps]
    got = C.context_partition(spark.createDataFrame(rows, "doc long, pos long, cost long, label string"), "doc", "pos", "cost", 60, overlap, structural)
    found = {}
    for r in got.collect():
        found.setdefault(r.doc, []).append((r.context, r.pos, r.part))
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(parts(ps, 60, overlap, structural)) for d, ps in docs.items()}
    assert all(sorted(p for _, p, part in x if part == "primary") == [p[0] for p in docs[d]] for d, x in found.items())


def windows(units, most, overlap):
    """(window, pos, part, omitted) of (pos, cost, grp, head)."""
    out, at, number = [], 0, 0
    cost = lambda xs: sum(x[1] for x in xs)
    while at < len(units):
        run = at
        while run < len(units) and units[run][2] == units[at][2]:
            run += 1
        before, head = units[max(0, at - overlap) : at], units[at][3]
        size = lambda e: cost(before) + cost(units[at : e + overlap]) + head
        fits = [e for e in range(at + 1, run + 1) if size(e) <= most]
        end, omitted = (fits[-1], []) if fits else (at + 1, ["heading", "after", "before"])
        if not fits:
            for left, around in ((["heading"], cost(before) + cost(units[end : end + overlap])), (["heading", "after"], cost(before))):
                if units[at][1] + around <= most:
                    omitted = left
                    break
        number += 1
        shown = ([("before", x) for x in before] if "before" not in omitted else []) + [("primary", x) for x in units[at:end]] + ([("after", x) for x in units[end : end + overlap]] if "after" not in omitted else [])
        out += [(number, x[0], part, omitted) for part, x in shown]
        at = end
    return out


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_windows(spark, overlap):
    rng = random.Random(overlap + 10)
    docs = {}
    for d in range(150):
        n, grp = rng.randrange(1, 30), 0
        docs[d] = [(2 * i, rng.choice([0, 3, 8, 20, 45, 70]), (grp := grp + (rng.random() < 0.15)), rng.choice([0, 10])) for i in range(n)]
    rows = [(d, p, c, g, h) for d, ps in docs.items() for p, c, g, h in ps]
    got = C.context_windows(spark.createDataFrame(rows, "doc long, pos long, cost long, grp long, head long"), "doc", "pos", "cost", 60, overlap, "grp", "head")
    found = {}
    for r in got.collect():
        found.setdefault(r.doc, []).append((r.window, r.pos, r.part, list(r.omitted)))
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(windows(ps, 60, overlap)) for d, ps in docs.items()}


def test_empty(spark):
    none = spark.createDataFrame([], "doc long, pos long, cost long, label string")
    assert C.context_partition(none, "doc", "pos", "cost", 10).count() == 0 == C.context_windows(none, "doc", "pos", "cost", 10, 1).count()
