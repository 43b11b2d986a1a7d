import random

import pytest

from docloom.operators import segmentation as S
from docloom.operators.folds import start_roles

LEVELS = {"region": 1, "site": 2, "grave": 2}


def line(kind="content", **more):
    return {"kind": kind, **more}


def cand(n, suffix="", **more):
    return line("candidate", number=n, suffix=suffix, label=f"{n}{suffix}", **more)


def head(kind, name):
    return line("heading", heading_kind=kind, level=LEVELS[kind], heading=name)


def frame(spark, docs):
    rows = []
    for d, lines in enumerate(docs):
        for p, x in enumerate(lines):
            base = {"doc": d, "pos": p, "segment": f"s{p}", "start": 0, "stop": 5, "page": 1, "unit": 0, "crop": 0, "region": "catalogue"} | x
            rows.append(tuple(base.get(c.split(" ")[0]) for c in S.LINE.split(", ")))
    return S.lines_of(spark.createDataFrame(rows, S.LINE))


def walk(lines):
    """One document, line after line: (ledger, blocks, diagnostics)."""
    starts = [i for i, x in enumerate(lines) if x["kind"] == "candidate" and not x.get("restart")]
    walls, written, before = [], [], -1
    for i in starts:
        between = lines[before + 1 : i]
        walls.append(any(x["kind"] in S.ENDS for x in between))
        sources = ([lines[before]] if before >= 0 else []) + [x for x in between if x["kind"] == "content"]
        written.append([n for x in sources for n in x.get("inline") or []])
        before = i
    roles = dict(zip(starts, start_roles([lines[i]["number"] for i in starts], [lines[i].get("suffix", "") for i in starts], walls, written)))
    ident = lambda x: (x["number"], x.get("suffix", ""))
    ledger, made, notes = [], [], []
    block, why, after, last, trouble, force, doubt, once = None, None, False, None, False, {}, set(), set()
    for i, x in enumerate(lines):
        kind, role, reason, owner = x["kind"], None, None, None
        scoped = kind == "series" or kind == "candidate" and x.get("restart")
        if kind in ("withheld", "duplicate", "furniture", "excluded_region"):
            role = "excluded"
            reason = {"withheld": f"segment_status:{x.get('status')}", "duplicate": "duplicate_observation", "furniture": "furniture", "excluded_region": "region:catalogue"}[kind]
        elif kind in ("figure", "glossary", "reference"):
            role = kind
        elif kind in ("section", "heading", "hint", "unclassified_heading"):
            block, why, after = None, None, True
            if kind == "section":
                force, doubt = {}, set()
                role, reason = "heading", "catalogue"
            elif kind == "heading":
                force = {k: v for k, v in force.items() if k < x["level"]} | {x["level"]: x}
                doubt -= {k for k, v in LEVELS.items() if v >= x["level"]}
                role = "heading"
            else:
                doubt = set(LEVELS)
                role, reason = "unresolved", "unclassified_heading"
        elif scoped:
            code = "scoped_series" if kind == "series" else "numbering_restart"
            if code not in once:
                notes.append((i, code))
                once.add(code)
            block, why = None, "scoped_identity_unsupported"
            role, reason = "unresolved", why
        elif kind == "candidate" and roles[i] == "entry":
            if last is not None and not trouble and (gap := x["number"] - last[0] - 1) > 0:
                notes.append((i, "numbering_gap" if gap <= 5 else "numbering_jump"))
            block = {"label": x["label"], "own": [i], "heads": [v["heading"] for _, v in sorted(force.items()) if v["heading_kind"] not in doubt], "unsure": sorted(doubt)}
            if doubt:
                notes.append((i, "heading_state_uncertain"))
            made.append(block)
            why, after, last, trouble = None, False, ident(x), False
            role, owner = "entry", len(made)
        elif kind == "candidate" and roles[i] == "list_item" and block is not None:
            block["own"].append(i)
            role, owner = "entry", len(made)
        elif kind == "candidate":
            copies = sum(ident(lines[j]) == ident(x) for j in starts)
            if "+" in roles[i]:
                why = "duplicate_identity" if copies > 1 and "exception" in roles[i] else "ambiguous_start"
            else:
                why = "sequence_exception" if last is None or last < ident(x) else "duplicate_identity" if last == ident(x) else "backward_label"
            notes.append((i, why))
            block, trouble = None, True
            role, reason = "unresolved", why
        elif block is not None and x.get("lost"):
            block, why, trouble = None, "unnumbered_item", True
            role, reason = "unresolved", why
        elif block is not None:
            block["own"].append(i)
            role, owner = "entry", len(made)
        else:
            role = "unresolved"
            reason = why or ("unnumbered_item" if x.get("list_item") else "orphan_after_heading" if after else "orphan_before_first_entry")
        ledger.append((role, reason, owner))
    if not made:
        notes.append((None, "no_records"))
    return ledger, made, sorted(notes, key=repr)


#: One small document for each theme of the acceptance cases.
THEMES = {
    "ambiguous end": [cand(1), line(), line("hint"), line(), cand(2)],
    "column, page and PDF page continuation": [cand(1), line(crop=1), line(page=2), line(unit=1, page=2), cand(2, page=2)],
    "ambiguous duplicate": [cand(1), cand(2), cand(2), cand(3)],
    "clean duplicate observation": [cand(1), line(), line("duplicate"), line(), cand(2)],
    "early nested lists": [cand(1), cand(1), cand(2), cand(2), cand(3)],
    "glossary": [line("section"), line("glossary"), line("glossary"), line("section"), cand(1)],
    "over-long heading": [cand(1), line("unclassified_heading"), cand(2), line()],
    "heading hint": [head("region", "North"), cand(1), line("hint"), cand(2)],
    "heading labels": [head("region", "North"), head("site", "Mill"), cand(1)],
    "heading hierarchy": [head("region", "N"), head("site", "A"), cand(1), head("grave", "G"), cand(2), head("region", "S"), cand(3)],
    "mixed page": [line("furniture"), line(), head("site", "A"), line(), cand(1), line("figure"), line(), line("furniture")],
    "lost marker": [cand(1), line(), line(lost=True, list_item=True), line(), cand(2), line()],
    "unnumbered list": [line(list_item=True), line(list_item=True), cand(1)],
    "no records": [line(), line("section"), line()],
    "unicode labels": [cand(1, "a"), cand(1, "β"), line(), cand(2)],
    "numbering: suffix, repeat, restart, series": [cand(7, "a"), cand(7, "b"), cand(7, "b"), cand(9), cand(1, restart=True), line(), line("series"), line(), cand(30)],
    "references": [cand(1), line("section"), line("reference"), line("reference")],
    "two entries in one segment": [cand(1, segment="s", start=0, stop=4), line(segment="s", start=5, stop=9), cand(2, segment="s", start=10, stop=14), line(segment="s", start=15, stop=19)],
    "unclassified heading": [head("site", "A"), cand(1), line("unclassified_heading"), cand(2), head("region", "B"), cand(3), head("site", "C"), cand(4)],
    "withheld segments": [cand(1), line("withheld", status="failed"), line(), line("withheld", status="skipped"), cand(2)],
}


def compare(spark, docs):
    done = S.disposed(S.resolved_starts(frame(spark, docs))).cache()
    built = S.blocks(done, LEVELS).cache()
    want = [walk(d) for d in docs]
    got = {(r.doc, r.pos): (r.role, r.reason, r.block) for r in S.dispositions(done).collect()}
    assert got == {(d, p): x for d, (ledger, *_) in enumerate(want) for p, x in enumerate(ledger)}
    told = {(r.doc, r.block): (r.label, r.lines, list(r.headings), sorted(r.unsure)) for r in built.collect()}
    assert told == {(d, i + 1): (b["label"], len(b["own"]), b["heads"], b["unsure"]) for d, (_, made, _) in enumerate(want) for i, b in enumerate(made)}
    notes = {}
    for r in S.diagnostics(done, built).collect():
        notes.setdefault(r.doc, []).append((r.pos, r.code))
    assert {d: sorted(n, key=repr) for d, n in notes.items()} == {d: n for d, (*_, n) in enumerate(want) if n}
    for r in S.coverage(done).collect():
        roles = [x[0] for x in want[r.doc][0]]
        assert (r.lines, r.entries, r.unresolved, r.complete) == (len(roles), len(want[r.doc][1]), roles.count("unresolved"), "unresolved" not in roles)
        assert dict(r.roles) == {x: roles.count(x) for x in set(roles)} and sum(r.excluded.values()) == roles.count("excluded")
    return want, built


def test_themes(spark):
    want, built = compare(spark, list(THEMES.values()))
    at = list(THEMES)
    row = {(at[r.doc], r.block): r for r in built.collect()}
    assert row["column, page and PDF page continuation", 1].continuation and not row["glossary", 1].continuation
    assert list(row["heading hierarchy", 2].headings) == ["N", "G"] and list(row["heading hierarchy", 3].headings) == ["S"]
    assert [tuple(x) for x in row["two entries in one segment", 1].spans] == [("s", 0, 9)]
    assert [x[0] for x in want[at.index("lost marker")][0]] == ["entry", "entry", "unresolved", "unresolved", "entry", "entry"]
    assert len(THEMES) == 20


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed):
    rng = random.Random(seed)
    kinds = ["content"] * 6 + ["candidate"] * 8 + ["section", "heading", "hint", "unclassified_heading", "series", "figure", "furniture", "duplicate", "withheld", "glossary", "reference", "excluded_region"]

    def one():
        out, n = [], 0
        for _ in range(rng.randrange(1, 25)):
            kind = rng.choice(kinds)
            if kind == "candidate":
                n = rng.choice([n + 1, n + 1, n, 1, 2, n + 9])
                out.append(cand(n, rng.choice(["", "", "a"]), restart=rng.random() < 0.08, inline=rng.choice([None, [1], [1, 2]])))
            elif kind == "heading":
                out.append(head(rng.choice(list(LEVELS)), f"h{rng.random():.4f}"))
            else:
                out.append(line(kind, lost=rng.random() < 0.2, list_item=rng.random() < 0.3, status="failed", inline=rng.choice([None, [1], [2]])))
        return out

    compare(spark, [one() for _ in range(150)])


def test_spans_and_contexts(spark):
    docs = [[head("site", "A"), cand(1, segment="a", start=0, stop=4), line(segment="a", start=5, stop=9), line("furniture", segment="a", start=10, stop=14), line(segment="a", start=15, stop=19), cand(2, segment="b")]]
    done = S.disposed(S.resolved_starts(frame(spark, docs)))
    spans = {r.block: [tuple(x) for x in r.spans] for r in S.blocks(done, LEVELS).collect()}
    assert spans == {1: [("a", 0, 9), ("a", 15, 19)], 2: [("b", 0, 5)]}
    around = sorted((r.block, r.pos, r.start, r.stop) for r in S.block_contexts(done, 2, 3).collect())
    assert around == [(1, 0, 2, 5), (1, 5, 0, 3), (2, 2, 6, 9), (2, 4, 16, 19)]


def test_empty(spark):
    none = frame(spark, [[line()]]).limit(0)
    done = S.disposed(S.resolved_starts(none))
    assert done.count() == S.blocks(done, LEVELS).count() == S.coverage(done).count() == 0


def test_ledger_issues(spark):
    texts = spark.createDataFrame([(1, "a", "one two  "), (1, "b", "three"), (1, "c", "   "), (1, "d", "never")], "doc long, segment string, text string")
    rows = [(1, "a", 0, 3), (1, "a", 4, 7), (1, "b", 0, 3), (1, "b", 2, 4), (1, "x", 0, 1), (1, "b", 9, 9)]
    ledger = spark.createDataFrame(rows, "doc long, segment string, start long, stop long")
    got = sorted(tuple(r)[1:] for r in S.ledger_issues(ledger, texts).collect())
    assert got == [("b", "beyond", 9, 9), ("b", "gap", 4, 9), ("b", "overlap", 2, 3), ("d", "gap", 0, 5), ("x", "unknown", 0, 1)]
    whole = spark.createDataFrame([(1, "a", 0, 7), (1, "b", 0, 5), (1, "d", 0, 5)], "doc long, segment string, start long, stop long")
    assert S.ledger_issues(whole, texts).count() == 0


def test_owned_ranges_cover_once(spark):
    rng = random.Random(5)
    lines, regions, texts = [], [], []
    for d in range(30):
        n = 0
        for s in range(rng.randrange(1, 5)):
            raw = "\n".join("w" * rng.randrange(1, 6) + "  " + "v" * rng.randrange(1, 6) for _ in range(rng.randrange(1, 4)))
            texts.append((d, f"s{s}", raw))
            at = 0
            for part in raw.split("\n"):
                lines.append((d, n, f"s{s}", at, at + len(part), part))
                at, n = at + len(part) + 1, n + 1
        cuts = sorted({(0, lines[-n][3])} | {(k, lines[-n + k][3] + rng.randrange(len(lines[-n + k][5]))) for k in range(n) for _ in range(2) if rng.random() < 0.4})
        regions += [(d, i, k, a, rng.choice(["record", "other", "unresolved"])) for i, (k, a) in enumerate(cuts)]
    frames = spark.createDataFrame(regions, "doc long, region long, at_line long, at long, kind string"), spark.createDataFrame(lines, "doc long, line long, segment string, start long, stop long, text string")
    got = S.owned_ranges(*frames)
    want = []
    for d, i, k, a, kind in regions:
        after = min(((k2, a2) for d2, _, k2, a2, _ in regions if d2 == d and (k2, a2) > (k, a)), default=(10**9, 0))
        pieces = []
        for _, n, seg, s, e, text in (x for x in lines if x[0] == d and k <= x[1] <= after[0]):
            lo, hi = (a if n == k else s), (after[1] if n == after[0] else e)
            part = text[lo - s : hi - s]
            if part.strip():
                lo, hi = lo + len(part) - len(part.lstrip()), hi - len(part) + len(part.rstrip())
                if pieces and pieces[-1][0] == seg:
                    pieces[-1][2] = hi
                else:
                    pieces.append([seg, lo, hi])
        want += [(d, seg, lo, hi, kind, i) for seg, lo, hi in pieces]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert S.ledger_issues(got, spark.createDataFrame(texts, "doc long, segment string, text string")).count() == 0


def test_observed_places(spark):
    lines = spark.createDataFrame([(1, 0, 100, "Plum tart, then plum jam"), (1, 1, 200, "Grave  Twelve with urn"), (1, 2, 300, "plain line"), (1, 3, 400, "left right")], "doc long, line long, start long, text string")
    replies = [
        (1, 0, "record", None, "plum"), (1, 0, "other", None, "jam"),  # plum stands twice: the line has no place
        (1, 1, "record", "twelve", "GRAVE twelve"), (1, 1, "record", "thirteen", "grave twelve"),
        (1, 2, "record", None, " "), (1, 2, "other", None, None),
        (1, 3, "record", "nine", "right"), (1, 3, "other", None, "left"), (1, 9, "other", None, "x"),
    ]
    got = sorted(tuple(r) for r in S.observed_places(spark.createDataFrame(replies, "doc long, line long, kind string, label string, text string"), lines).collect())
    assert got == [
        (1, 0, 100, "unresolved", None, "boundary_unplaced"), (1, 1, 200, "record", "twelve", "label_not_in_source"), (1, 2, 300, "unresolved", None, None),
        (1, 3, 400, "other", None, None), (1, 3, 405, "record", None, "label_not_in_source"),
    ]


def test_tasks_grow_with_the_table(spark, sf, monkeypatch):
    """Documents are dealt to as many tasks as the table's rows ask for, also behind the joins of resolved starts."""
    monkeypatch.setattr(S, "tasks_for", lambda table: 40)
    assert S.segmented_lines(spark, sf).rdd.getNumPartitions() == 40
    lines, tasks = S._routed_lineitems(spark, sf)
    assert S.disposed(S.resolved_starts(lines, tasks)).rdd.getNumPartitions() == 40
