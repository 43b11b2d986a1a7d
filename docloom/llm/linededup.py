"""Line dedup by two Bloom filters.

A first pass over the texts fills two filters of one bounded size: keys seen in one document, and keys seen in a second
one too. The second pass sends only the keys that the twice-seen filter knows, as their SHA-256: an exact count of
their documents confirms the repeats and chooses the document that keeps the line. Lines themselves never leave their
task; the texts of documents that lose a line meet their list of keys, the others pass where they lie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, SLOT_ROWS, in_slots, materialize, sieve, slot_bits, slot_filter, slot_rows, spread_join, table

WHITE = b" \t\n\x0b\x0c\r"
_FLUSH = 500_000


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of every line: stripped and with A-Z lower-cased; None below min_chars code points."""
    keys = (line.strip(WHITE) for line in (text or b"").translate(LOWER_AZ).split(b"\n"))
    return [k if len(k) >= min_chars and (k.isascii() or len(k.decode("utf-8", "replace")) >= min_chars) else None for k in keys]


def _hashed(keys: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


ONCE, TWICE = 1, 2


def _seen(state: np.ndarray, slots: np.ndarray, n: np.ndarray) -> None:
    """Bit 1 of a slot is the once-seen filter's, bit 2 the twice-seen one's."""
    state[slots[(n > 1) | (state[slots] & ONCE > 0)]] |= TWICE
    state[slots] |= ONCE


def suspected(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, digest) of every key that may be in more than one document: all that are, and chance hits of the filter."""

    def fill(batches):
        some, size = [], 0
        for b in batches:
            for text in b.column(1):
                some.append(_hashed({k for k in line_keys(text.as_py(), min_chars) if k is not None}))
                size += len(some[-1])
                if size >= _FLUSH:
                    yield slot_rows(np.concatenate(some), 2)
                    some, size = [], 0
        if size:
            yield slot_rows(np.concatenate(some), 2)

    twice = slot_filter(docs.mapInArrow(fill, SLOT_ROWS), _seen, lambda state: state & TWICE > 0)

    def ask(batches):
        bits = slot_bits(twice.value)
        for b in batches:
            ids, digests = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                keys = [k for k in {k for k in line_keys(text.as_py(), min_chars) if k is not None}]
                if i is None or not keys:
                    continue
                hit = in_slots(bits, np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)))
                found = [hashlib.sha256(keys[j]).digest() for j in np.flatnonzero(hit)]
                ids += [i] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "digest"])

    return docs.mapInArrow(ask, "doc_id long, digest binary")


def _cut(batches, min_chars: int):
    for b in batches:
        out = []
        for i, text, gone in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            text, gone = text.as_py() or b"", set(gone.as_py() or ())
            lines = text.split(b"\n")
            kept = lines if not gone else [x for x, k in zip(lines, line_keys(text, min_chars)) if k is None or hashlib.sha256(k).digest() not in gone]
            out.append((i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)] if out else [pa.array([], t) for t in _TYPES], names=["doc_id", "n_lines", "n_dropped", "kept"])


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row a document: doc_id, n_lines (before dropping), n_dropped, kept (its other lines, joined by newlines).

    A key of at least min_chars code points in at least min_docs documents loses its lines in all of them but the one of
    the largest doc_id, where all its lines stay. Null and empty texts are one empty line. Rows of one doc_id are one
    document, and each gives a row; a row without doc_id is in no document, counts for no key and loses nothing.
    Texts of any length are read whole; shorter lines stay. There are no ties, as documents are told apart by their ids.
    An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pairs = materialize(suspected(docs, min_chars).distinct())
    confirmed = pairs.groupBy("digest").agg(F.count("*").alias("k"), F.max("doc_id").alias("last")).where(F.col("k") >= min_docs)
    found = spread_join(pairs, confirmed, "digest", "k", pairs.count()).where("doc_id <> last")
    gone = materialize(found.groupBy("doc_id").agg(F.collect_list("digest").alias("gone")))
    passed, stopped = sieve(docs, gone, [F.col("doc_id")], ["doc_id"])
    whole = passed.select("*", F.lit(None).cast("array<binary>").alias("gone")).union(stopped.join(gone.hint("merge"), "doc_id", "left"))
    return whole.mapInArrow(lambda batches: _cut(batches, min_chars), "doc_id long, n_lines long, n_dropped long, kept string")


def op12_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_linededup": op12_linededup}
ORACLES = {
    "op12_linededup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
