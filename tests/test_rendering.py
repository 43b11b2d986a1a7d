import html
import random
import re

from docloom.operators import rendering as R


def test_markdown_bytes(spark):
    rng = random.Random(2)
    blocks = [(d, p, i, rng.choice(["", "aé", "漢字\nx", "\U0001f600 end", None])) for d in range(8) for p in range(rng.randrange(4)) for i in range(rng.randrange(1, 4))]
    frame = spark.createDataFrame(blocks, "doc long, page int, nth int, text string")
    text = {r.doc: r.markdown.encode() for r in R.markdown(frame, "doc").collect()}
    spans = R.markdown_spans(frame, "doc")
    for r in spans.collect():
        assert text[r.doc][r.start : r.stop].decode() == (r.text or "")
    for d in {b[0] for b in blocks}:
        want = "\n\n".join(b[3] or "" for b in sorted((b for b in blocks if b[0] == d), key=lambda b: b[1:3]))
        assert text[d].decode() == (want + "\n" if want else "")
    pages = {(r.doc, r.page): (r.start, r.stop) for r in R.page_spans(spans, "doc").collect()}
    assert pages.keys() == {(b[0], b[1]) for b in blocks}
    assert R.markdown_spans(frame.limit(0), "doc").count() == 0 == R.markdown(frame.limit(0), "doc").count()


PASSAGE = "doc long, segment string, place int, label string, page int, text string, rows int, columns int"
CELL = "doc long, segment string, cell string, row int, column int, rowspan int, colspan int, role string, start int, stop int, text string"


def test_tags_can_be_taken_off(spark):
    text = 'Head <1> & "x": a & b | c<d  tail\u0001'
    passages = [(1, "p", 0, 'l"<', 3, "1 < 2 & 'q'", None, None), (1, "t", 1, "Table", 3, text, 1, 2), (1, "e", 2, None, 4, None, None, None), (1, "n", 3, "Table", 4, "no cells", 1, 1), (1, "bad", 4, "Table", 4, "abcdef", 1, 2), (1, "far", 5, "Table", 4, "ab", 1, 1)]
    at = [(text.index("a & b"), "a & b"), (text.index("c<d"), "c<d")]
    cells = [(1, "t", f"c{i}", 0, i, 1, 1, 'ro"le' if i else None, a, a + len(t), t) for i, (a, t) in enumerate(at)]
    cells += [(1, "bad", "x", 0, 0, 1, 1, None, 0, 3, "abc"), (1, "bad", "y", 0, 1, 1, 1, None, 2, 4, "cd"), (1, "far", "z", 0, 0, 1, 1, None, 1, 9, "b")]
    blocks, issues = R.tagged_source(spark.createDataFrame(passages, PASSAGE), spark.createDataFrame(cells, CELL), "doc")
    got = {r.segment: r.block for r in blocks.collect()}
    assert {(r.segment, r.cell) for r in issues.collect()} == {("bad", "y"), ("far", "z")} and got.keys() == {"p", "t", "e", "n"}
    raw = {p[1]: p[5] or "" for p in passages}
    assert all(html.unescape(re.sub(r"<[^>]*>", "", block)) == raw[s] for s, block in got.items())
    assert got["p"] == '<block id="p" label="l&quot;&lt;" page="3">1 &lt; 2 &amp; \'q\'</block>'
    assert '<cell id="c1" row="0" column="1" rowspan="1" colspan="1" role="ro&quot;le">c&lt;d</cell>' in got["t"] and got["n"].endswith('<table rows="1" columns="1">no cells</table></block>')


def test_contributions(spark):
    rows = [
        ("r", "s", 1, "scalar", None), ("r", "s", 2, "scalar", ["a"]), ("r", "s", 3, "scalar", ["b"]), ("r", "s", 4, "scalar", ["a"]),
        ("r", "l", 1, "array", ["x"]), ("r", "l", 2, "array", ["x"]), ("r", "l", 3, "array", ["y"]), ("r", "l", 4, "array", ["x", "y"]), ("r", "l", 5, "array", ["x"]), ("r", "n", 1, "array", None), (None, "s", 1, "scalar", ["q"]), (None, "s", 2, "scalar", ["w"]),
    ]
    merged, conflicts = R.merged_contributions(spark.createDataFrame(rows, "rec string, path string, seq int, kind string, v array<string>").repartition(3), ["rec", "path"], "seq", "kind", "v")
    assert {(r.rec, r.path): r.value for r in merged.collect()} == {("r", "s"): ["a"], ("r", "l"): ["x", "y", "x"], ("r", "n"): None, (None, "s"): ["q"]}
    assert {(r.rec, r.path, r.seq, tuple(r.kept), tuple(r.proposed)) for r in conflicts.collect()} == {("r", "s", 3, ("a",), ("b",)), (None, "s", 2, ("q",), ("w",))}
