"""Nested records: leaves, fit to a schema, typed values, and tables for export.

A record is JSON text. One pass over it (`record_leaves`) gives its leaves or cells as rows; rows, joins of rows with
what they share, and columns are Spark's from there on.
"""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from docloom.functions.text import typed_integer, typed_number
from docloom.sources.tables import read_table as T
from docloom.sources.tables import tasks_for
from docloom.sources.written import materialize


def json_leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of a flat JSON object's non-blank leaves; malformed JSON has none."""
    rows = df.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))
    return rows.where(F.trim("value") != "")


def leaves_of_json(spark, sf):
    return json_leaves(T(spark, sf, "events"), "event_id", "props")


def conform(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Adds a typed column for each field of a JSON object: unknown keys go, blank and mistyped values become null."""
    make = {"integer": typed_integer, "number": typed_number, "string": lambda c: F.when(F.trim(c) != "", c)}
    return df.withColumns({name: make[kind](F.get_json_object(column, f"$.{name}")) for name, kind in fields.items()})


def conform_json(spark, sf):
    return conform(T(spark, sf, "events").select("event_id", "props"), "props", {"k": "integer", "missing": "string"}).drop("props")


def eav_to_records(df: DataFrame, key: str, path: str, value: str, paths: list[str]) -> DataFrame:
    """One row a key with a column for each declared path: the paths are given, so nothing is scanned to find them."""
    return df.groupBy(key).pivot(path, paths).agg(F.max(value))


def event_counts_by_type(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    ev = T(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return eav_to_records(ev, "user_id", "event_type", "n", kinds)


def nested_orders(spark, sf) -> DataFrame:
    """Orders with their lines as an array in line order."""
    li = T(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    return T(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(li, "o_orderkey", "left")


def export_root_rows(spark, sf):
    """One row an order: its lines' numbers and parts as lists in one column each."""
    joined = lambda c: F.array_join(F.transform("lines", lambda x: x[c].cast("string")), ", ")
    return nested_orders(spark, sf).select("o_orderkey", "o_orderstatus", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"), joined("l_linenumber").alias("numbers"), joined("l_partkey").alias("parts"))


def export_nested_rows(spark, sf):
    """One row a line with its order's columns; orders without lines have none."""
    return nested_orders(spark, sf).select("o_orderkey", "o_orderstatus", F.explode("lines").alias("l")).select("o_orderkey", "o_orderstatus", "l.l_linenumber", "l.l_partkey", "l.l_quantity")


@dataclass(frozen=True)
class Field:
    """A field of a record's schema: string, integer, number, boolean, object (fields), or an array of scalars (items) or
    of objects (fields). allowed: the only texts that a string may have."""

    name: str
    kind: str
    fields: tuple[Field, ...] = ()
    items: str | None = None
    allowed: tuple[str, ...] | None = None


def _blank(v) -> bool:
    return v is None or isinstance(v, str) and not v.strip()


def fitted(value, fields: tuple[Field, ...]) -> dict:
    """A parsed record restricted to its schema, in schema order: unknown keys go, missing and blank values are null,
    and so are lists without items and values of another structure at a list or an object. Scalars stay what they are,
    whatever their type; so do the items of a list of scalars that are not null or blank."""
    given = value if isinstance(value, dict) else {}

    def fit(v, f: Field):
        if _blank(v):
            return None
        if f.kind == "object":
            return fitted(v, f.fields) if isinstance(v, dict) else None
        if f.kind == "array":
            items = v if isinstance(v, list) else []
            return ([x for x in items if not _blank(x)] if f.items else [fitted(x, f.fields) for x in items if isinstance(x, dict)]) or None
        return v

    return {f.name: fit(given.get(f.name), f) for f in fields}


def typed(value, kind: str, allowed: tuple[str, ...] | None = None):
    """A scalar as its declared kind, or None where it is none: 12 from "12" or 12.0, 1.5 from "1,5", "5" from 5, trimmed
    text. Nothing but true and false is a boolean, and they are nothing else."""
    if kind == "boolean" or isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return value if kind == "boolean" and isinstance(value, bool) else None
    if kind == "string":
        text = str(value).strip()
        return text if text and (allowed is None or text in allowed) else None
    if kind == "integer":
        whole = int(value) if isinstance(value, str) and value.strip().isdecimal() or isinstance(value, float) and value.is_integer() else value
        return whole if isinstance(whole, int) and abs(whole) < 1 << 63 else None
    try:
        number = float(str(value).replace(",", "."))
    except ValueError:
        return None
    return (value if isinstance(value, int) else number) if math.isfinite(number) else None


_dump = json.JSONEncoder(ensure_ascii=False).encode


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else _dump(v)


@functools.cache
def escaped(name: str) -> str:
    """A name as a step of a path: backslashes and dots get a backslash, and so does a number, which would be a place."""
    step = name.replace("\\", "\\\\").replace(".", "\\.")
    return "\\" + step if name.isdecimal() and name.isascii() else step


def _parsed(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def _leaves(record, fields: tuple[Field, ...], rows: tuple[str, ...], joined: bool, raw=_dump):
    """(name, shared, order, repeated, kind, raw, value) of each filled leaf. raw: makes that column. shared: places in the lists on the way to
    the rows, which names leave out; repeated: inside another list of objects; kind `row` marks an item that is a row."""

    def walk(value, level, name, shared, order, way, repeated):
        for n, f in enumerate(level):
            v = value.get(f.name) if isinstance(value, dict) else None
            if v is None:
                continue
            here, at = (f"{name}." if name else "") + escaped(f.name), (*order, n)
            ahead = way[1:] if way and way[0] == f.name else None
            if f.kind == "object":
                yield from walk(v, f.fields, here, shared, at, ahead, repeated)
            elif f.kind == "array" and f.fields:
                for i, x in enumerate(v if isinstance(v, list) else []):
                    if ahead is None:
                        yield from walk(x, f.fields, f"{here}.{i}", shared, (*at, i), None, True)
                        continue
                    if not ahead:
                        yield None, (*shared, i), (), False, "row", None, None
                    yield from walk(x, f.fields, here, (*shared, i), at, ahead or None, repeated)
            elif f.kind == "array":
                values = v if isinstance(v, list) else []
                if joined:
                    yield here, shared, at, repeated, "list", raw(values), ", ".join(_text(typed(x, f.items, f.allowed)) or "" for x in values)
                else:
                    for i, x in enumerate(values):
                        yield f"{here}.{i}", shared, (*at, i), repeated, f.items, raw(x), _text(typed(x, f.items, f.allowed))
            else:
                yield here, shared, at, repeated, f.kind, raw(v), _text(typed(v, f.kind, f.allowed))

    return walk(record, fields, "", (), (), rows or None, False)


_PLACES = K.ArrayType(K.IntegerType())
_LEAF = K.StructType([K.StructField(n, t) for n, t in zip("name shared order repeated kind raw value".split(), (K.StringType(), _PLACES, _PLACES, K.BooleanType(), K.StringType(), K.StringType(), K.StringType()))])


def record_leaves(df: DataFrame, keys: list[str], column: str, fields: tuple[Field, ...], rows: tuple[str, ...] = (), fit: bool = True, joined: bool = False, wanted: tuple[str, ...] = tuple(_LEAF.names)) -> DataFrame:
    """(keys, name, shared, order, repeated, kind, raw, value): the leaves of JSON records, a row each, where they lie.

    value is typed and as text, null where raw (the JSON of what stands there) is not of the field's kind, so nothing is
    lost in silence. order is the place in the schema with places in lists, by which leaves sort. Names are escaped
    paths. fit: restrict records to the schema first. rows: the names down to the list whose items are rows, none for
    whole records. joined: one cell for a list of scalars. wanted: the columns to
    make besides the keys, in their order; others cost time. What is no JSON object has no leaves.
    """
    at = [_LEAF.names.index(n) for n in wanted]
    schema = K.StructType([*df.select(*keys).schema.fields, *(_LEAF[n] for n in wanted)])
    types = [[pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.string(), pa.string()][i] for i in at]
    raw = _dump if "raw" in wanted else lambda v: None

    def run(batches):
        for b in batches:
            took, out = [], []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                record = _parsed(text)
                for leaf in _leaves(fitted(record, fields) if fit else record, fields, rows, joined, raw):
                    took.append(i)
                    out.append(leaf)
            made = list(zip(*out)) if out else [[]] * len(_LEAF)
            columns = [made[n] for n in at]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(took, pa.int32())) for c in b.columns[: len(keys)]), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=schema.names)

    return df.select(*keys, column).mapInArrow(run, schema)


def export_cells_of(df: DataFrame, keys: list[str], column: str, fields: tuple[Field, ...], rows: tuple[str, ...] = (), omit: bool = False, fit: bool = True, wanted: tuple[str, ...] = ("name", "order", "kind", "value")) -> tuple[DataFrame, DataFrame]:
    """(rows, cells) of an export: rows (keys, row) and cells (keys, row, name, order, kind, value), row being the places of
    the row's item in the lists down to it, empty for whole records.

    rows: the names down to a list of objects, each item of which is a row with the cells of what is above it; a record
    without such items has no row. Cells in other lists of objects have their places in the name, or none with omit.
    The keys tell records apart and are not null. wanted: the columns of cells besides keys and row.
    """
    leaves = record_leaves(df, keys, column, fields, rows, fit, True, ("shared", *(["repeated"] if omit else []), *dict.fromkeys([*(["kind"] if rows else []), *wanted])))
    leaves = leaves.where("not repeated").drop("repeated") if omit else leaves
    if not rows:
        return df.select(*keys, F.array().cast("array<int>").alias("row")), leaves.select(*keys, F.col("shared").alias("row"), *wanted)
    leaves = materialize(leaves)
    found = leaves.where("kind = 'row'").select(*keys, F.col("shared").alias("row"))
    above = found.withColumn("n", F.explode(F.sequence(F.lit(0), F.size("row")))).withColumn("shared", F.expr("slice(row, 1, n)")).drop("n")
    return found, leaves.where("kind <> 'row'").join(above, [*keys, "shared"]).select(*keys, "row", *wanted)


def declared_columns(fields: tuple[Field, ...], rows: tuple[str, ...] = ()) -> list[tuple[str, tuple[int, ...], str]]:
    """(name, order, kind) of the columns that an export has without any data: those in no list of objects but the ones
    on the way to the rows."""
    out = []

    def walk(level, name, order, way):
        for n, f in enumerate(level):
            here, ahead = (f"{name}." if name else "") + escaped(f.name), way[1:] if way and way[0] == f.name else None
            if f.kind == "object" or f.kind == "array" and f.fields and ahead is not None:
                walk(f.fields, here, (*order, n), ahead or None)
            elif not f.fields:
                out.append((here, (*order, n), "list" if f.kind == "array" else f.kind))

    walk(fields, "", (), rows or None)
    return out


def row_paths(fields: tuple[Field, ...]) -> list[tuple[str, ...]]:
    """The paths whose items can be the rows of an export, in schema order; () stands for whole records."""
    out: list[tuple[str, ...]] = [()]

    def walk(level, path):
        for f in level:
            here = (*path, f.name)
            out.extend([here] if f.kind == "array" and f.fields else [])
            walk(f.fields, here)

    walk(fields, ())
    return out


#: An export beyond this many columns is refused; its cells (`export_cells_of`) have no such limit.
MOST_COLUMNS = 2000


def export_table(df: DataFrame, keys: list[str], column: str, fields: tuple[Field, ...], rows: tuple[str, ...] = (), omit: bool = False, fit: bool = True, most: int = MOST_COLUMNS) -> DataFrame:
    """(keys, row, and a column a cell name, in schema order): see export_cells_of. Declared columns are there even if
    empty; columns with places in them, for the places that some record fills."""
    if rows not in row_paths(fields):
        raise ValueError(f"no list of objects at {rows}")
    listed, cells = export_cells_of(df, keys, column, fields, rows, omit, fit)
    cells = materialize(cells)
    seen = cells.groupBy("name").agg(F.min("order").alias("order"), F.first("kind").alias("kind")).limit(most + 1).collect()
    columns = {r["name"]: (tuple(r["order"]), r["kind"]) for r in seen} | {n: (o, k) for n, o, k in declared_columns(fields, rows)}
    if len(columns) > most:
        raise ValueError(f"more than {most} columns; take the cells instead")
    order = sorted(columns, key=lambda n: columns[n][0])
    wide = cells.groupBy(*keys, "row").pivot("name", order).agg(F.first("value"))
    kinds = {"integer": "bigint", "number": "double", "boolean": "boolean"}
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return listed.join(wide, [*keys, "row"], "left").select(*keys, "row", *(quoted(n).cast(kinds.get(columns[n][1], "string")).alias(n) for n in order))


def _ddl(fields: tuple[Field, ...]) -> K.StructType:
    kinds = {"string": K.StringType(), "integer": K.LongType(), "number": K.DoubleType(), "boolean": K.BooleanType()}
    of = lambda f: _ddl(f.fields) if f.kind == "object" else K.ArrayType(kinds[f.items] if f.items else _ddl(f.fields)) if f.kind == "array" else kinds[f.kind]
    return K.StructType([K.StructField(f.name, of(f)) for f in fields])


def _coerced(record: dict, fields: tuple[Field, ...]) -> dict:
    """A fitted record with typed scalars; items of a list that are of another kind go."""
    def one(v, f):
        if v is None or f.kind == "object":
            return v and _coerced(v, f.fields)
        if f.kind == "array":
            return ([y for x in v if (y := typed(x, f.items, f.allowed)) is not None] if f.items else [_coerced(x, f.fields) for x in v]) or None
        return typed(v, f.kind, f.allowed)

    return {f.name: one(record[f.name], f) for f in fields}


def conform_nested(df: DataFrame, column: str, fields: tuple[Field, ...]) -> DataFrame:
    """The JSON text of a column in two steps: `<column>_fit`, the text of the record restricted to the schema with every
    scalar as it was said, and the column itself as a typed struct. What the second step can't type is null there and
    still in the first. What is no JSON object has all fields null."""

    @F.udf("struct<fit:string,typed:string>", useArrow=True)
    def both(text):
        fit = fitted(_parsed(text), fields)
        return json.dumps(fit, ensure_ascii=False), json.dumps(_coerced(fit, fields), ensure_ascii=False)

    said = df.withColumn("__both", both(F.col(column)))
    return said.withColumns({f"{column}_fit": F.col("__both.fit"), column: F.from_json("__both.typed", _ddl(fields))}).drop("__both")


def lossless(value, field: Field):
    """A saved value brought to a field's structure with nothing dropped: a composite at a scalar becomes its JSON text, a
    lone item a list of one, and a scalar where an object should be goes to the object's first field."""
    cell = lambda v: v if v is None or isinstance(v, (str, bool, int, float)) else json.dumps(v, ensure_ascii=False)
    if value is None:
        return None
    if field.kind == "object":
        if isinstance(value, dict):
            return {f.name: lossless(value.get(f.name), f) for f in field.fields}
        return {field.fields[0].name if field.fields else "": cell(value)}
    if field.kind == "array":
        items = value if isinstance(value, list) else [value]
        return [cell(x) if field.items else lossless(x, Field(field.name, "object", field.fields)) for x in items]
    return cell(value)


def violations(value, field: Field, path: tuple = ()):
    """(path, code) of what keeps a value from being one of its field: type, not_allowed, extra_field or missing_field. A
    null fits any field; an object has every field of its schema, be it null, and no other."""
    if value is None:
        return
    if field.kind == "object":
        if not isinstance(value, dict):
            yield path, "type"
            return
        names = {f.name for f in field.fields}
        yield from (((*path, n), "extra_field") for n in value if n not in names)
        for f in field.fields:
            if f.name not in value:
                yield (*path, f.name), "missing_field"
            else:
                yield from violations(value[f.name], f, (*path, f.name))
    elif field.kind == "array":
        if not isinstance(value, list):
            yield path, "type"
            return
        inner = Field(field.name, field.items, allowed=field.allowed) if field.items else Field(field.name, "object", field.fields)
        for i, x in enumerate(value):
            yield from violations(x, inner, (*path, i))
    else:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        fits = {"string": isinstance(value, str), "boolean": isinstance(value, bool), "number": number, "integer": number and float(value).is_integer()}[field.kind]
        if not fits:
            yield path, "type"
        elif field.allowed is not None and value not in field.allowed:
            yield path, "not_allowed"


def validated(df: DataFrame, keys: list[str], column: str, fields: tuple[Field, ...]) -> DataFrame:
    """(keys, path, code): the violations of JSON records against their schema, a row each; text that is no JSON object has
    the one of code malformed. path is a JSON array."""
    schema = K.StructType([*df.select(*keys).schema.fields, K.StructField("path", K.StringType()), K.StructField("code", K.StringType())])
    root = Field("", "object", fields)

    def run(batches):
        for b in batches:
            took, out = [], []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                record = _parsed(text)
                for path, code in violations(record, root) if isinstance(record, dict) else [((), "malformed")]:
                    took.append(i)
                    out.append((json.dumps(path, ensure_ascii=False, separators=(",", ":")), code))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(took, pa.int32())) for c in b.columns[: len(keys)]), *(pa.array(list(c), pa.string()) for c in (zip(*out) if out else ([], [])))], names=schema.names)

    return df.select(*keys, column).mapInArrow(run, schema)


def value_at(record: Column, path: tuple[str | int, ...]) -> Column:
    """The value at a path of names and list places; null where there is none."""
    for step in path:
        record = F.get(record, F.lit(step)) if isinstance(step, int) else record[step]
    return record


def canonical_json(df: DataFrame, column: str) -> DataFrame:
    """The JSON text of a column in its one form: keys sorted, no blanks, text as text. No JSON, or numbers that JSON
    hasn't: null."""

    def canon(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array(map(canon, b.column(at).to_pylist()), b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


_LINE = (Field("number", "integer"), Field("part", "integer"), Field("note", "string"))
ORDER = (Field("status", "string"), Field("customer", "object", (Field("id", "integer"), Field("name", "string"))), Field("tags", "array", items="string"), Field("lines", "array", _LINE))


def raw_orders(spark, sf) -> DataFrame:
    """(o_orderkey, raw): orders as JSON as a model might answer: keys in another order, unknown keys, blanks, other types.
    Lines come by number, part and note."""
    line = F.struct(F.lit(1).alias("extra"), F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(" ")).otherwise(F.col("l_returnflag")).alias("note"), F.col("l_linenumber").alias("number"))
    lines = T(spark, sf, "lineitem")
    # rows are small beside the work on them, so tasks are told by rows
    tasks = tasks_for(lines, 50_000)
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey").repartition(tasks, "o_orderkey")
    li = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("ls"))
    o = T(spark, sf, "orders").repartition(tasks, "o_orderkey").join(li, "o_orderkey", "left")
    tags = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.col("o_orderstatus"))).otherwise(F.array(F.lit(" ")))
    raw = F.to_json(F.struct(F.transform("ls", lambda x: x["line"]).alias("lines"), F.lit(7).alias("unknown"), tags.alias("tags"), F.struct(F.lit(5).alias("name"), F.col("o_custkey").alias("id")).alias("customer"), F.col("o_orderstatus").alias("status")))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.lit("{broken")).otherwise(raw).alias("raw"))


def conform_nested_orders(spark, sf):
    """Leaves of the orders, each with its path, after conformance."""
    return record_leaves(raw_orders(spark, sf), ["o_orderkey"], "raw", ORDER, wanted=("name", "value")).where("value is not null").select("o_orderkey", F.col("name").alias("path"), "value")


def export_cells(spark, sf):
    """The filled cells of the export table of the orders, which has columns for all lines of the longest one."""
    _, cells = export_cells_of(raw_orders(spark, sf), ["o_orderkey"], "raw", ORDER, wanted=("name", "value"))
    return cells.where("value is not null").select("o_orderkey", "name", "value")


def export_line_cells(spark, sf):
    """The cells of the export that has a row a line: the line's own and, on each, those of its order."""
    _, cells = export_cells_of(raw_orders(spark, sf), ["o_orderkey"], "raw", ORDER, ("lines",), omit=True, wanted=("name", "value"))
    return cells.where("value is not null").select("o_orderkey", F.get("row", F.lit(0)).cast("long").alias("line"), "name", "value")


def order_violations(spark, sf):
    """What is wrong with the raw orders, counted by code and field."""
    found = validated(raw_orders(spark, sf), ["o_orderkey"], "raw", ORDER)
    last = F.element_at(F.split(F.regexp_replace("path", r"[\[\]\"]", ""), ","), -1)
    return found.groupBy("code", last.alias("field")).agg(F.count("*").alias("n"))


def canonical_props(spark, sf):
    df = canonical_json(T(spark, sf, "events").select("event_id", "props"), "props")
    return df.select("event_id", "props", F.sha2("props", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (leaves_of_json, conform_json, event_counts_by_type, export_root_rows, export_nested_rows, conform_nested_orders, export_cells, export_line_cells, order_violations, canonical_props)}
_N = "WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem)"
#: Lines of an order with equal number and part sort by their note, which only odd lines have, as in `raw_orders`.
_ORDERS = """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 50 <> 0),
        l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 <> 0 THEN l_returnflag END AS note, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 <> 0 THEN l_returnflag END) - 1 AS i FROM lineitem JOIN o ON l_orderkey = o_orderkey),
        line AS (SELECT l_orderkey, i, 'number' AS name, l_linenumber::VARCHAR AS value FROM l UNION ALL SELECT l_orderkey, i, 'part', l_partkey::VARCHAR FROM l UNION ALL SELECT l_orderkey, i, 'note', note FROM l WHERE note IS NOT NULL),
        top AS (SELECT o_orderkey, 'status' AS name, o_orderstatus AS value FROM o WHERE trim(o_orderstatus) <> '' UNION ALL SELECT o_orderkey, 'customer.id', o_custkey::VARCHAR FROM o WHERE o_custkey IS NOT NULL
            UNION ALL SELECT o_orderkey, 'customer.name', '5' FROM o UNION ALL SELECT o_orderkey, 'tags', 'a, ' || o_orderstatus FROM o WHERE o_orderkey % 3 = 0)"""
ORACLES = {
    "leaves_of_json": "SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE trim(json_extract_string(props, '$.' || k)) <> ''",
    "conform_json": "SELECT event_id, CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '[0-9]+') THEN json_extract_string(props, '$.k')::BIGINT END AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    "event_counts_by_type": "SELECT user_id, " + ", ".join(f"nullif(count(*) FILTER (event_type = '{k}'), 0) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "export_root_rows": _N + """, m AS (SELECT l_orderkey, count(*) AS n_lines, string_agg(l_linenumber, ', ' ORDER BY i) AS numbers, string_agg(l_partkey, ', ' ORDER BY i) AS parts FROM n GROUP BY 1)
        SELECT o_orderkey, o_orderstatus, coalesce(n_lines, 0) AS n_lines, numbers, parts FROM orders LEFT JOIN m ON l_orderkey = o_orderkey""",
    "conform_nested_orders": _ORDERS + """
        SELECT o_orderkey, name AS path, value FROM top WHERE name <> 'tags'
        UNION ALL SELECT o_orderkey, 'tags.0', 'a' FROM o WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, 'tags.1', o_orderstatus FROM o WHERE o_orderkey % 3 = 0 AND trim(o_orderstatus) <> ''
        UNION ALL SELECT l_orderkey, 'lines.' || i || '.' || name, value FROM line""",
    "export_cells": _ORDERS + " SELECT * FROM top UNION ALL SELECT l_orderkey, 'lines.' || i || '.' || name, value FROM line",
    "export_line_cells": _ORDERS + """ SELECT l_orderkey AS o_orderkey, i AS line, 'lines.' || name AS name, value FROM line
        UNION ALL SELECT o_orderkey, i, name, value FROM top JOIN l ON o_orderkey = l_orderkey""",
    "order_violations": """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 50 <> 0), l AS (SELECT lineitem.* FROM lineitem JOIN o ON l_orderkey = o_orderkey)
        SELECT 'malformed' AS code, '' AS field, count(*) AS n FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'extra_field', 'unknown', count(*) FROM o
        UNION ALL SELECT 'type', 'name', count(*) FROM o UNION ALL SELECT 'extra_field', 'extra', count(*) FROM l
        UNION ALL SELECT 'missing_field', 'lines', count(*) FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l_orderkey = o_orderkey) HAVING count(*) > 0""",
    "canonical_props": "SELECT event_id, replace(props, ' ', '') AS props, sha256(replace(props, ' ', '')) AS sha256 FROM events",
    "export_nested_rows": "SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
}
