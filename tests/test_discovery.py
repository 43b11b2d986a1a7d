"""Assembly of windows against a plain walk from window to window."""

import random

from docloom.operators.discovery import assemble

WINDOWS = "doc int, k int, start int, stop int, ok boolean, begins boolean, ends boolean, withheld boolean"
PLACES = "doc int, k int, at int, kind string, label string"


def walk(windows, places):
    """Regions as [start, kind, label, end]; `live` is the record that is still open."""
    out, live, before = [], None, None

    def finish(how):
        nonlocal live
        if live is not None:
            live[3] = how
        live = None

    for _, k, start, _, ok, begins, ends, _ in windows:
        if not ok:
            finish("unresolved")
            out.append([start, "unresolved", None, None])
            before = (False, None)
            continue
        tidy = before is not None and before[0] and before[1] is False
        mine = sorted(p[2:] for p in places if p[1] == k)
        if mine and mine[0][0] == start:
            finish("validated" if tidy and begins is False else "unresolved")
        elif not (before and before[0] and before[1] is True and begins is True and live is not None):
            finish("validated" if tidy else "unresolved")
            out.append([start, "other" if begins is False and (before is None or tidy) else "unresolved", None, None])
        for at, kind, label in mine:
            finish("unresolved" if kind == "unresolved" else "validated")
            out.append([at, kind, label, None])
            live = out[-1] if kind == "record" else None
        before = (True, ends)
    last = windows[-1]
    finish({False: "validated", None: "unresolved", True: "unresolved" if last[7] else "source_end"}[last[6]])
    stops = [r[0] for r in out[1:]] + [last[3]]
    return [(r[0], stop, *r[1:]) for r, stop in zip(out, stops)]


def test_against_a_walk(spark):
    rng, windows, places, want = random.Random(8), [], [], set()
    for doc in range(150):
        mine = [(doc, k, 10 * k, 10 * k + 10, rng.random() < 0.85, rng.choice([True, True, False, None]), rng.choice([True, True, False, None]), rng.random() < 0.5) for k in range(rng.randint(1, 7))]
        there = [(doc, k, 10 * k + at, rng.choice(["record", "record", "other", "unresolved"]), f"l{at}") for _, k, *_ in mine for at in rng.sample(range(10), rng.choice([0, 0, 1, 2, 4])) if rng.random() < 0.8]
        windows, places = windows + mine, places + there
        want |= {(doc, *r) for r in walk(mine, there)}
    found = assemble(spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(places, PLACES), "doc", "k").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert {r.end for r in found} == {None, "validated", "unresolved", "source_end"}


def test_no_windows(spark):
    assert assemble(spark.createDataFrame([], WINDOWS), spark.createDataFrame([], PLACES), "doc", "k").isEmpty()
