import json

import pytest

from docloom.operators import records as R

FIELDS = (
    R.Field("a.b", "string"), R.Field("n", "number"), R.Field("ok", "boolean"), R.Field("none", "array", items="string"),
    R.Field("list", "array", (R.Field("x", "integer"), R.Field("in", "array", (R.Field("t", "array", items="string"),)))), R.Field("empty", "array", (R.Field("y", "string"),)),
)
ROWS = [
    (1, '{"list": [{"x": 1, "in": [{"t": ["p", "", "q"]}, {"t": []}]}, 5, null, {"x": "no"}], "a.b": "v", "n": 2, "ok": true, "other": 1}'),
    (2, '{"a.b": " ", "n": "2", "ok": null, "list": [], "none": [null, ""]}'), (3, "[1]"), (4, None), (5, "{bad"), (6, '{"n": 1.5, "list": {"x": 1}}'),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, raw string")


def test_fit_keeps_what_typing_drops(spark):
    df = R.conform_nested(frame(spark, ROWS), "raw", FIELDS)
    got = {r.id: r.raw.asDict(True) for r in df.collect()}
    assert got[1] == {"a.b": "v", "n": 2.0, "ok": True, "none": None, "empty": None, "list": [{"x": 1, "in": [{"t": ["p", "q"]}, {"t": None}]}, {"x": None, "in": None}]}
    blank = {"a.b": None, "n": None, "ok": None, "none": None, "list": None, "empty": None}
    assert got[3] == got[4] == got[5] == blank and got[6] == {**blank, "n": 1.5} and got[2] == {**blank, "n": 2.0}
    fit = {r.id: json.loads(r.raw_fit) for r in df.collect()}
    assert fit[1]["list"][1] == {"x": "no", "in": None} and fit[2]["n"] == "2" and list(fit[1]) == [f.name for f in FIELDS]


def test_typed_values():
    cases = [("integer", "12", 12), ("integer", 12.0, 12), ("integer", " 7 ", 7), ("integer", 1.5, None), ("integer", "-3", None), ("integer", "²", None), ("integer", 1 << 70, None), ("integer", True, None)]
    cases += [("number", "1,5", 1.5), ("number", 3, 3), ("number", "nan", None), ("number", "x", None), ("number", [1], None), ("string", 5, "5"), ("string", " a ", "a"), ("string", False, None), ("string", {"a": 1}, None)]
    cases += [("boolean", True, True), ("boolean", "true", None), ("boolean", 1, None)]
    for kind, value, want in cases:
        got = R.typed(value, kind)
        assert got == want and type(got) is type(want), (kind, value)
    assert R.typed("red", "string", ("red", "blue")) == "red" and R.typed("green", "string", ("red", "blue")) is None
    assert R.fitted({"t": ["a", 1, True, None, " ", [2]]}, (R.Field("t", "array", items="string"),)) == {"t": ["a", 1, True, [2]]}


def test_leaves_tell_what_stands_there(spark):
    rows = R.record_leaves(frame(spark, ROWS), ["id"], "raw", FIELDS).collect()
    got = {(r.id, r.name): (r.value, r.raw) for r in rows}
    assert got[1, "list.1.x"] == (None, '"no"') and got[2, "n"] == ("2.0", '"2"') and got[1, "list.0.in.0.t.1"] == ("q", '"q"')
    one = sorted((list(r.order), r.name) for r in rows if r.id == 1)
    assert [n for _, n in one] == ["a\\.b", "n", "ok", "list.0.x", "list.0.in.0.t.0", "list.0.in.0.t.1", "list.1.x"] and not {3, 4, 5} & {r.id for r in rows}


def text(name, kind="string"):
    return R.Field(name, kind)


#: A report with parts that hold passages (text and marks) and remarks, and with people.
REPORT = (
    text("name"), R.Field("about", "object", (text("year", "integer"), R.Field("parts", "array", (
        text("head"), R.Field("passages", "array", (text("text"), R.Field("marks", "array", items="string"))), R.Field("remarks", "array", (text("sort"),)))))),
    R.Field("people", "array", (text("who"),)), text("_own"), text("end"),
)
PASSAGES = ("about", "parts", "passages")
DECLARED = ["name", "about.year", "about.parts.head", "about.parts.passages.text", "about.parts.passages.marks", "_own", "end"]


def table(spark, records, fields, rows=(), **more):
    df = R.export_table(frame(spark, [(i, json.dumps(x)) for i, x in enumerate(records)]), ["id"], "raw", fields, rows, **more)
    return df.columns[2:], [tuple(r)[2:] for r in sorted(df.collect(), key=lambda r: (r.id, r.row))]


def test_rows_of_a_nested_path(spark):
    assert R.row_paths(REPORT) == [(), ("about", "parts"), PASSAGES, ("about", "parts", "remarks"), ("people",)]
    record = {"name": "N", "about": {"year": "1999", "parts": [{"head": "A", "passages": [{"text": "one", "marks": ["x", "y"]}, {"text": "two", "marks": []}]}, {"head": "B", "passages": [{"text": "three"}], "remarks": [{"sort": "r"}]}, {"head": "C"}]}, "people": [{"who": "p"}], "end": "e"}
    columns, rows = table(spark, [record, {"name": "without"}], REPORT, PASSAGES, omit=True, fit=False)
    assert columns == DECLARED
    assert rows == [("N", 1999, "A", "one", "x, y", None, "e"), ("N", 1999, "A", "two", "", None, "e"), ("N", 1999, "B", "three", None, None, "e")]
    columns, rows = table(spark, [record], REPORT, PASSAGES)
    assert columns == DECLARED[:5] + ["about.parts.remarks.0.sort", "people.0.who"] + DECLARED[5:]
    assert [r[5:7] for r in rows] == [(None, "p"), (None, "p"), ("r", "p")]


def test_whole_records_and_empty_lists(spark):
    columns, rows = table(spark, [{"name": "a", "about": {"year": 1}}, {"_own": "o", "end": "z"}], REPORT, omit=True)
    assert columns == ["name", "about.year", "_own", "end"] and rows == [("a", 1, None, None), (None, None, "o", "z")]
    columns, rows = table(spark, [{"name": "a", "about": {"parts": [{"head": "h", "passages": []}]}}], REPORT, PASSAGES, omit=True)
    assert columns == DECLARED and rows == []
    df = R.export_table(frame(spark, ROWS).limit(0), ["id"], "raw", FIELDS)
    assert df.columns == ["id", "row", "a\\.b", "n", "ok", "none"] and df.isEmpty()


def test_names_do_not_collide(spark):
    fields = (text("a.b"), R.Field("a", "object", (text("b"), text("0"))), text("a\\b"), R.Field("items", "array", (text("name"),)), R.Field("items.0", "object", (text("name"),)))
    columns, rows = table(spark, [{"a.b": "1", "a": {"b": "2", "0": "3"}, "a\\b": "4", "items": [{"name": "5"}], "items.0": {"name": "6"}}], fields)
    assert columns == ["a\\.b", "a.b", "a.\\0", "a\\\\b", "items.0.name", "items\\.0.name"] and rows == [("1", "2", "3", "4", "5", "6")]


def test_too_many_columns_are_refused(spark):
    record = {"list": [{"x": i} for i in range(50)]}
    with pytest.raises(ValueError, match="cells"):
        table(spark, [record], FIELDS, most=20)
    with pytest.raises(ValueError, match="no list"):
        table(spark, [record], FIELDS, ("list", "x"))


def test_lossless_fit():
    fields = R.Field("r", "object", (text("t"), R.Field("l", "array", items="string"), R.Field("o", "array", (text("x"), text("y")))))
    assert R.lossless({"t": {"a": [1]}, "l": "one", "o": 5, "z": 1}, fields) == {"t": '{"a": [1]}', "l": ["one"], "o": [{"x": 5}]}
    assert R.lossless("lone", fields) == {"t": "lone"} and R.lossless(None, fields) is None and R.lossless({"l": [None, [1], True]}, fields) == {"t": None, "l": [None, "[1]", True], "o": None}


def test_violations(spark):
    fields = (text("t"), R.Field("n", "integer"), R.Field("c", "string", allowed=("red",)), R.Field("l", "array", (text("x"),)))
    rows = [(1, '{"t": "a", "n": 3.0, "c": "red", "l": [{"x": null}]}'), (2, '{"t": 1, "n": 1.5, "c": "blue", "l": {}, "z": 0}'), (3, '{"t": null, "n": true, "l": [{"y": 1}, 4]}'), (4, "{bad"), (5, None), (6, "[]")]
    got = sorted((r.id, r.path, r.code) for r in R.validated(frame(spark, rows), ["id"], "raw", fields).collect())
    assert got == [
        (2, '["c"]', "not_allowed"), (2, '["l"]', "type"), (2, '["n"]', "type"), (2, '["t"]', "type"), (2, '["z"]', "extra_field"),
        (3, '["c"]', "missing_field"), (3, '["l",0,"x"]', "missing_field"), (3, '["l",0,"y"]', "extra_field"), (3, '["l",1]', "type"), (3, '["n"]', "type"),
        (4, "[]", "malformed"), (5, "[]", "malformed"), (6, "[]", "malformed"),
    ]


def test_canonical_json(spark):
    rows = [(1, '{"b": 1, "a": {"d": "ü", "c": [1, 2.50, null]}}'), (2, '{"a":{"c":[1,2.5,null],"d":"ü"},"b":1}'), (3, "{bad"), (4, None), (5, '{"x": NaN}')]
    got = {r.id: r.j for r in R.canonical_json(spark.createDataFrame(rows, "id long, j string"), "j").collect()}
    assert got[1] == got[2] == '{"a":{"c":[1,2.5,null],"d":"ü"},"b":1}' and got[3] is got[4] is got[5] is None


def test_wanted_columns_and_dealt_orders(spark, sf):
    """Leaves have the wanted columns alone, and small orders are still dealt to all cores."""
    whole = R.record_leaves(frame(spark, ROWS), ["id"], "raw", FIELDS).select("value", "name").collect()
    some = R.record_leaves(frame(spark, ROWS), ["id"], "raw", FIELDS, wanted=("value", "name"))
    assert some.columns == ["id", "value", "name"] and sorted(map(str, some.drop("id").collect())) == sorted(map(str, whole))
    assert R.raw_orders(spark, sf).rdd.getNumPartitions() == 8
