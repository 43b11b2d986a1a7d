"""Where merged values come from: a record's replies stream past its leaves, whose places in lists are whole items."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.pandas.types import to_arrow_type

from docloom.sources.tables import read_table as T
from docloom.sources.tables import tasks_for


def _form(v):
    """Equal and of equal hash for equal values: objects in any order of keys, lists in theirs, numbers by value; true is not 1."""
    if isinstance(v, dict):
        return "object", tuple((k, _form(v[k])) for k in sorted(v))
    if isinstance(v, list):
        return "list", tuple(map(_form, v))
    if v is None or isinstance(v, bool) or v != v:
        return "other", repr(v)
    return int(v) if isinstance(v, float) and v.is_integer() else v


def _is_leaf(v) -> bool:
    """Text that isn't blank, and numbers."""
    return isinstance(v, str) and v.strip() != "" or isinstance(v, (int, float)) and not isinstance(v, bool)


_step = lru_cache(4096)(lambda name: json.dumps(name, ensure_ascii=False))


class _Places:
    """Where the leaves of merged records stand: steps are names, and in lists the whole items, by value."""

    def __init__(self):
        self.names: dict[str, _Places] = {}
        self.items: dict = {}
        self.leaves: dict = {}

    def add(self, v, steps: tuple[str, ...], leaf) -> None:
        """Puts leaf(steps) at each leaf of v."""
        if isinstance(v, dict):
            for name, x in v.items():
                self.names.setdefault(name, _Places()).add(x, (*steps, _step(name)), leaf)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                self.items.setdefault(_form(x), _Places()).add(x, (*steps, str(i)), leaf)
        elif _is_leaf(v):
            self.leaves.setdefault(_form(v), []).append(leaf(steps))

    def meet(self, v, steps: tuple[str, ...]):
        """(what stands here, steps of v) for each leaf of v that stands here too; what no record has is left at its first step."""
        if isinstance(v, dict):
            for name, x in v.items():
                if name in self.names:
                    yield from self.names[name].meet(x, (*steps, _step(name)))
        elif isinstance(v, list):
            for i, x in enumerate(v) if self.items else ():
                here = self.items.get(_form(x))
                if here is not None:
                    yield from here.meet(x, (*steps, str(i)))
        elif self.leaves and _is_leaf(v):
            for leaf in self.leaves.get(_form(v), ()):
                yield leaf, steps


def _path(steps: tuple[str, ...]) -> str:
    return f"[{','.join(steps)}]"


def _parsed(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


#: Rows that leave a task together.
_MOST_ROWS = 20_000


def _origins(batches, identity: frozenset[str], schema: K.StructType):
    """Rows of value_origins() from rows (key, side, unit, text) sorted by key and side: merged records (0), then replies (1).
    What is held of a key are the leaves of its merged records and one reply."""
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    out: list[list] = [[] for _ in kinds]

    def put(*row):
        for c, x in zip(out, row):
            c.append(x)

    def batch():
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=schema.names)
        for c in out:
            c.clear()
        return b

    def said(unit, text, alone):
        for leaf, steps in places.meet(_parsed(text), ()):
            source = _path(steps)
            if not alone or leaf[0] == source:
                leaf[1] = True
                put(key, leaf[0], "value", unit, source)
                if len(out[0]) >= _MOST_ROWS:
                    yield batch()

    def finished():
        if held is not None:
            yield from said(*held, replies == 1)
        for path, met in leaves:
            if not met:
                put(key, path, "unknown", None, None)
        if len(out[0]) >= _MOST_ROWS:
            yield batch()

    key, places, leaves, held, replies = None, _Places(), [], None, 0

    def leaf(steps):
        x = [_path(steps), False]
        leaves.append(x)
        return x

    for b in batches:
        for k, side, unit, text in zip(*(b.column(n).to_pylist() for n in range(4))):
            # a null key is no one's; NaN is one key
            if k is None or k != key and (k == k or key == key):
                yield from finished()
                key, places, leaves, held, replies = k, _Places(), [], None, 0
            if side == 0:
                record = _parsed(text)
                named = isinstance(record, dict)
                for name in identity.intersection(record) if named else ():
                    _Places().add(record[name], (_step(name),), lambda steps: put(key, _path(steps), "inventory", None, None))
                places.add({n: x for n, x in record.items() if n not in identity} if named else record, (), leaf)
            elif k is not None:
                if held is not None and leaves:
                    yield from said(*held, False)
                held, replies = (unit, text), replies + 1
    yield from finished()
    yield batch()


def value_origins(merged: DataFrame, replies: DataFrame, key: str, unit: str, column: str, identity: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """(key, path, kind, unit, source): for each leaf of a merged record the replies (key, unit, column) and the paths in them
    that it comes from. Leaves are text that isn't blank, and numbers; a path is a JSON array of names and places. What is no
    JSON has none.

    A leaf comes from the same field of a reply with an equal value; in a list, from every equal item as a whole, not from
    an item that only has the same leaf. A record with one reply was not merged, so there places are kept. Leaves of the
    identity fields are of kind `inventory`, without a reply; leaves that no reply has are `unknown`, with null unit
    and source; all others `value`.

    Records and replies cross one shuffle, as texts, to `tasks` tasks (the session's number, if not given), and a key's replies
    stream past the leaves of its merged record; records without a key are dealt by their texts.
    """
    side = lambda df, n, u: df.select(F.col(key).alias("key"), F.lit(n).alias("side"), u.alias("unit"), F.col(column).alias("text"))
    rows = side(merged, 0, F.lit(None).cast(replies.schema[unit].dataType)).union(side(replies, 1, F.col(unit)))
    by = [F.col("key"), F.when(F.col("key").isNull(), F.xxhash64("text"))]
    dealt = rows.repartition(tasks, *by) if tasks else rows.repartition(*by)
    kind = rows.schema
    schema = K.StructType([K.StructField(key, kind["key"].dataType), K.StructField("path", K.StringType()), K.StructField("kind", K.StringType()), K.StructField(unit, kind["unit"].dataType), K.StructField("source", K.StringType())])
    named = frozenset(identity)
    return dealt.sortWithinPartitions("key", "side").mapInArrow(lambda batches: _origins(batches, named, schema), schema)


def record_identity(revision: Column, scope: Column) -> Column:
    """The id of a record: the digest of its schema revision and scope."""
    return F.sha2(F.to_json(F.array(revision.cast("string"), scope.cast("string"))), 256)


def value_identity(record: Column, field: Column) -> Column:
    """The id of a value: the digest of its record's id and its field."""
    return F.sha2(F.to_json(F.array(record.cast("string"), field.cast("string"))), 256)


def digest_uuid(digest: Column) -> Column:
    """A digest as a UUID of version 5 form."""
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.substring(F.lit("89ab"), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def line_origins(spark, sf):
    """Orders as merged records of lines; odd and even lines came from two replies, and some of each were said twice."""
    li = T(spark, sf, "lineitem")
    tasks = tasks_for(li)
    li = li.repartition(tasks, "l_orderkey").select("l_orderkey", "l_linenumber", F.struct(F.col("l_partkey").alias("part"), F.struct(F.col("l_returnflag").alias("flag")).alias("note")).alias("x"))
    order = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda y: y["x"])
    head = F.struct(F.col("l_orderkey").alias("key"), F.lit("open").alias("state"), F.col("lines"))
    text = lambda df: df.withColumn("j", F.to_json(head))
    merged = text(li.groupBy("l_orderkey").agg(order(F.struct("x")).alias("lines"))).select("l_orderkey", "j")
    units = li.withColumn("unit", F.explode(F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("l_linenumber") % 2))))
    replies = text(units.groupBy("l_orderkey", "unit").agg(order(F.struct("x")).alias("lines"))).select("l_orderkey", "unit", "j")
    out = value_origins(merged, replies, "l_orderkey", "unit", "j", ("key",), tasks)
    # an order's rows meet at once, not first by path
    out = out.select("l_orderkey", "kind", "unit", "path").repartition(tasks, "l_orderkey")
    return out.groupBy("l_orderkey", "kind", "unit").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


QUERIES = {"line_origins": line_origins}
ORACLES = {
    # pairs of equal lines are counted: two leaves each; the state is in every reply
    "line_origins": """WITH l AS (SELECT l_orderkey, l_partkey AS p, l_returnflag AS f, l_linenumber % 3 = 0 AS twice, l_linenumber % 2 AS u FROM lineitem),
        r AS (SELECT l_orderkey, p, f, u FROM l WHERE NOT twice UNION ALL SELECT l_orderkey, p, f, unnest([0, 1]) FROM l WHERE twice),
        one AS (SELECT l_orderkey, count(DISTINCT u) = 1 AS alone FROM r GROUP BY 1),
        m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, f) AS i FROM l), q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, u ORDER BY p, f) AS i FROM r),
        x AS (SELECT m.l_orderkey, q.u, m.i FROM m JOIN q ON m.l_orderkey = q.l_orderkey AND m.p = q.p AND m.f = q.f JOIN one ON one.l_orderkey = m.l_orderkey WHERE NOT alone OR m.i = q.i)
        SELECT l_orderkey, 'inventory' AS kind, NULL::INTEGER AS unit, 1::BIGINT AS n, 1::BIGINT AS paths FROM one
        UNION ALL SELECT l_orderkey, 'value', u, 2 * count(*) + 1, 2 * count(DISTINCT i) + 1 FROM x GROUP BY 1, 3""",
}
