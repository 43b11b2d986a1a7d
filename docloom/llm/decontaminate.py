"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question with other parameters has the same template. Windows
of template words of the benchmark and of the documents are joined on their hashes; the slots under the joined windows
of one alignment must map one to one between item and document. Windows with too few words outside slots, and items no
longer than a window, are joined on their plain words too, so that verbatim copies of them are found.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, without

WINDOW = 10
MIN_LITERALS = 6
MIN_ITEM = 5
#: Up to so many distinct benchmark windows (8 bytes each) go to every task; beyond, all windows are shuffled to a join.
MAX_SENT = 2_000_000
_GROUP_BYTES = 400_000
#: Measures that a number may carry. Fixed values.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years c f k degree degrees hz khz mhz ghz w kw v a j kj cal kcal pa kpa percent dollar dollars usd euro euros eur cent cents kmh mph".split())
_UNIT_BYTES = frozenset(x.encode() for x in UNITS)

_LITERAL, _NUMBER, _CAPITAL, _UNIT, _DROP = range(5)
_HASH_OF = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>")) for k in ("number", "name", "unit")}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEEP = re.compile(r"[\W_]+")


class Vocabulary(dict):
    """Raw word -> row of (hash of the plain word, kind, whether it ends a sentence); forgets all when too large."""

    MOST = 200_000

    def __init__(self):
        super().__init__()
        self.hash, self.kind, self.ends, self.plain = np.zeros(1024, np.uint64), np.zeros(1024, np.int8), np.zeros(1024, bool), []

    def __missing__(self, raw: bytes) -> int:
        i = self[raw] = len(self.plain)
        if i == len(self.hash):
            self.hash, self.kind, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.kind, self.ends))
        stem = raw if raw.isalpha() else raw[:-1]
        if stem.isalpha() and (stem is raw or raw[-1] in b".,;:!?"):  # letters of ASCII, with a mark at most: most words
            low = stem.lower()
            kind = _UNIT if low in _UNIT_BYTES else _CAPITAL if stem[:1].isupper() and not stem.isupper() else _LITERAL
            ends = stem is not raw and raw[-1] in b".:!?"
        else:
            word = raw.decode("utf-8", "replace")
            plain = _KEEP.sub("", word)
            low = plain.lower()
            digits = sum(map(str.isdigit, plain))
            kind = _DROP if not plain else _NUMBER if digits and digits * 2 >= len(plain) or word[:1].isdigit() else _UNIT if low in UNITS else _CAPITAL if plain[0].isupper() and not plain.isupper() else _LITERAL
            low = low.encode()
            ends = raw == b"\x01" or word.rstrip("\"')]}”’»*#$%&|").endswith((".", "!", "?", "…", ":"))
        self.hash[i], self.kind[i], self.ends[i] = xxhash.xxh64_intdigest(low), kind, ends
        self.plain.append(low)
        return i

    def template(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, slot flag, vocabulary row and text number of every kept word of the texts."""
        if len(self.plain) > self.MOST:
            self.clear()
            self.__init__()
        raw, sizes = [], []
        for t in texts:
            words = (t or b"").replace(b"\n", b" \x01 ").split()
            words.append(b"\x01")
            raw += words
            sizes.append(len(words))
        ids = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        kept = np.flatnonzero(self.kind[ids] != _DROP)
        if not len(kept):
            return np.zeros(0, np.uint64), np.zeros(0, bool), kept, kept
        ended = np.concatenate([[0], np.cumsum(self.ends[ids])])[kept]
        initial = np.concatenate([[True], ended[1:] > ended[:-1]])
        doc = np.repeat(np.arange(len(sizes)), sizes)[kept]
        ids = ids[kept]
        kind, h = self.kind[ids], self.hash[ids]
        number, name = kind == _NUMBER, (kind == _CAPITAL) & ~initial
        unit = (kind == _UNIT) & np.concatenate([[False], number[:-1] & (doc[1:] == doc[:-1])])
        h[number], h[name], h[unit] = _HASH_OF["number"], _HASH_OF["name"], _HASH_OF["unit"]
        return h, number | name | unit, ids, doc


class Known:
    """The benchmark's window hashes, sorted, with a table of their top bits that turns most others away at once."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        bits = min(26, max(10, len(hashes).bit_length() + 5))
        self.shift, self.some = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.some[self.sorted >> self.shift] = True

    def where(self, x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.some[x >> self.shift])
        y = x[at]
        return at[self.sorted[np.minimum(np.searchsorted(self.sorted, y), len(self.sorted) - 1)] == y]


def windows(h: np.ndarray, slot: np.ndarray, doc: np.ndarray, widths, min_literals: int, known: Known | None = None):
    """For each width: (width, starts, hashes) of the windows inside one text with enough literal words; known: only these."""
    c = np.concatenate([[0], np.cumsum(~slot)])
    out = h
    for w in range(1, min(max(widths, default=0), len(h)) + 1):
        if w > 1:
            out = out[:-1] * _BASE + h[w - 1 :]
        if w in widths:
            x = out ^ (out >> np.uint64(32))
            at = np.arange(len(x)) if known is None else known.where(x)
            at = at[(doc[at] == doc[at + w - 1]) & (c[at + w] - c[at] >= min(min_literals, w - 1))]
            yield w, at, x[at]


def _emit(id_name: str, width: int, min_literals: int, lengths=None, known=None):
    """Windows of (id, text) batches, of template and (plain) of plain words: all of the given lengths, or of the text's own
    if it is shorter; known: only these. Only the benchmark's (no lengths given) plain windows carry their slots."""

    def groups(b):
        held, total = [], 0
        for key, t in zip(b.column(0).to_pylist(), b.column(1)):
            held.append((key, t.as_py()))
            total += len(held[-1][1] or b"")
            if lengths is None or total > _GROUP_BYTES:
                yield held
                held, total = [], 0
        if held:
            yield held

    def run(batches):
        vocab = Vocabulary()
        for b in batches:
            for held in groups(b):
                h, slot, words, doc = vocab.template([t for _, t in held])
                widths = [w for w in (lengths if lengths is not None else [min(width, len(h))]) if w]
                long = [w for w in widths if w >= MIN_ITEM]
                only = known.value if known is not None else None
                ways = [(False, windows(h, slot, doc, long, min_literals, only)), (True, windows(vocab.hash[words], slot, doc, widths, 0, only))]
                for plain, (w, at, x) in ((p, found) for p, way in ways for found in way):
                    if plain and lengths is None and len(h) > width:  # windows with enough literals have their template
                        few = np.convolve(~slot, np.ones(w, int), "valid")[at] < min(min_literals, w - 1)
                        at, x = at[few], x[few]
                    if len(x):
                        slots = [[vocab.plain[words[i]].decode() for i in range(a, a + w) if slot[i]] if not plain or lengths is None else [] for a in at.tolist()]
                        pos = at - np.searchsorted(doc, doc[at])
                        keys = [held[d][0] for d in doc[at].tolist()]
                        columns = [pa.array(keys, pa.int64()), pa.array(pos, pa.int32()), pa.array([w] * len(x), pa.int32()), pa.array([plain] * len(x)), pa.array(x.view(np.int64)), pa.array(slots, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, names=[id_name, "pos", "width", "plain", "hash", "slots"])

    return run, f"{id_name} long, pos int, width int, plain boolean, hash long, slots array<string>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, min_literals: int = MIN_LITERALS, max_sent: int = MAX_SENT) -> DataFrame:
    """One row a (document, item) that share a template window: doc_id, item_id, windows, first_pos, slots, changed, kind.

    kind is 'exact' if no slot value differs, else 'reparameterised'; then item and document values must map one to
    one over the whole alignment. Windows with fewer than min_literals words outside slots, and items under MIN_ITEM words,
    match word for word only. Items with fewer words than the window count as one window, null texts never match. Repeated documents or items give one row; a null doc_id is kept; empty tables
    give an empty result; other columns are not read.
    """
    run, schema = _emit("item_id", width, min_literals)
    items = benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("binary"))
    bench = materialize(items.mapInArrow(run, schema).distinct())
    lengths = sorted(r.width for r in bench.select("width").distinct().collect())  # at most `width` numbers
    hashes = bench.select("hash").distinct()
    spark, known = docs.sparkSession, None
    if 0 < hashes.count() <= max_sent:
        known = spark.sparkContext.broadcast(Known(np.array([r.hash for r in hashes.toLocalIterator()], np.int64).view(np.uint64)))
    run, schema = _emit("doc_id", width, min_literals, lengths, known)
    found = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, schema)
    d, b = found.alias("d"), bench.alias("b")
    pairs = d.join(b, (F.col("d.hash") == F.col("b.hash")) & (F.col("d.width") == F.col("b.width")) & (F.col("d.plain") == F.col("b.plain")) & (F.col("b.plain") | (F.size("d.slots") == F.size("b.slots"))))
    values = F.when(F.col("b.plain"), F.col("b.slots")).otherwise(F.col("d.slots"))
    pairs = pairs.select("doc_id", "item_id", "b.plain", F.col("d.pos").alias("pos"), (F.col("d.pos") - F.col("b.pos")).alias("shift"), F.arrays_zip(F.col("b.slots").alias("a"), values.alias("b")).alias("slots"))
    runs = pairs.groupBy("doc_id", "item_id", "plain", "shift").agg(F.countDistinct("pos").alias("windows"), F.min("pos").alias("first_pos"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    one_to_one = (F.size("slots") == F.size(F.array_distinct("slots.a"))) & (F.size("slots") == F.size(F.array_distinct("slots.b")))
    changed = F.size(F.filter("slots", lambda x: x["a"] != x["b"]))
    good = runs.where(one_to_one | (changed == 0)).withColumn("changed", changed).withColumn("slots", F.size("slots"))
    best = good.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("windows", "first_pos", "slots", "changed"), F.struct("windows", -F.col("changed"), -F.col("first_pos"))).alias("x"))
    return best.select("doc_id", "item_id", "x.*", F.when(F.col("x.changed") == 0, "exact").otherwise("reparameterised").alias("kind"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that share no template window with the benchmark; rows without an id stay, as do repeated rows
    of ids that stay. Texts that a filter of the ids that go lets pass cross no shuffle."""
    leaks = materialize(find_leaks(docs, benchmark, id_col, **options).where("doc_id is not null").select("doc_id").distinct())
    return without(docs, leaks, [F.col(id_col).cast("long")], ["doc_id"])


def op8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_templates": op8_templates}
ORACLES: dict[str, str] = {}
