from docloom.operators import lines


def test_lines_stay_where_they_are(spark, sf, monkeypatch):
    """Lengths are native, spans send no lines, and batches of lines are of bounded size."""
    monkeypatch.setattr(lines, "_MOST_CHARS", 4)
    texts = ["", " \t", None, "\n\n a b \r\n\x0b\x0c\nccc", " x\n ", "ä😀 \n", "x" * 50 + "\ny", "\x1c z\x85"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted(tuple(r) for r in lines.text_lines(docs).collect())
    want = []
    for i, t in enumerate(texts):
        at = 0
        for line in (t or "").split("\n"):
            body = line.strip(" \t\r\x0b\x0c")
            if body:
                a = at + line.index(body)
                want.append((i, a, a + len(body), body))
            at += len(line) + 1
    assert got == sorted(want)
    spans = lines.line_spans(docs)
    assert sorted(tuple(r) for r in spans.collect()) == sorted(x[:3] for x in want)
    assert sorted(tuple(r) for r in lines.line_lengths(docs, ["doc_id"]).collect()) == sorted((i, b - a) for i, a, b, _ in want)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" not in plan(lines.line_stats_by_lang(spark, sf)) and "line#" not in plan(spans)
