"""Substring deduplication on a de Bruijn graph of token k-mers.

An edge is a window of k words. Only edges in more than one document matter, and such an edge shares its anchor (the
smallest hash of the shorter windows inside it) with its copies: documents first exchange anchors, about a fifth as
many as words, and only windows over an anchor seen in two documents become edges. Joined with the first place of its
words, an edge has a source coordinate; edges that follow each other in the document and at the source alike form a
nonbranching path and are compacted to one span. The words of every span are compared, by digest, with those at the
source before they are removed. A document gives an edge once, at its first place; where it repeats the edge, its own
text tells the other places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K = 13
ANCHOR = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GROUP_WORDS = 250_000


class WordHash(dict):
    """Word -> 64-bit hash; forgets all when too large."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word)
        return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = out * _BASE + h[j : j + len(out)]
    return _mixed(out)


def _texts(batches, k: int):
    """Documents of k words or more in groups of bounded size: (rows of the batch, word hashes, first word of each)."""
    words = WordHash()
    for b in batches:
        rows, parts, total = [], [], 0
        for i, t in enumerate(b.column(1)):
            w = (t.as_py() or b"").split()
            if len(w) >= k:
                rows.append(i)
                parts.append(np.fromiter(map(words.__getitem__, w), np.uint64, len(w)))
                total += len(w)
            if total > _GROUP_WORDS:
                yield b, rows, parts
                rows, parts, total = [], [], 0
        if rows:
            yield b, rows, parts


def _windows(parts, k: int, anchor: int):
    """Of a group: start, document and anchor of every window inside one document; all word hashes."""
    h = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    small = rolling(h, anchor)
    n = len(h) - k + 1
    least = small[:n].copy()
    for j in range(1, k - anchor + 1):
        np.minimum(least, small[j : j + n], out=least)
    doc = np.repeat(np.arange(len(parts)), sizes)[:n]
    inside = np.arange(n) <= (first + sizes - k)[doc]
    at = np.flatnonzero(inside)
    return h, at, doc[at], least[at], first


def _firsts(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every value in every document, in order, and whether the document has it again."""
    order = np.lexsort((value, doc))  # stable: equal ones keep their order
    d, v = doc[order], value[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])])[: len(d)]
    again = np.concatenate([~new[1:], [False]])[: len(d)]
    at = order[new]
    up = np.argsort(at, kind="stable")
    return at[up], again[new][up]


def _anchors(k: int, anchor: int):
    def run(batches):
        for b, rows, parts in _texts(batches, k):
            ids = b.column(0).to_pylist()
            _, _, doc, least, _ = _windows(parts, k, anchor)
            first, _ = _firsts(doc, least)
            doc, least = doc[first], least[first]
            own = np.array([ids[i] for i in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[doc]), pa.array(least.view(np.int64))], names=["doc_id", "anchor"])

    return run


def _edges(k: int, anchor: int):
    """(doc_id, text, shared anchors) -> edges over them."""

    def run(batches):
        for b, rows, parts in _texts(batches, k):
            ids, shared = b.column(0).to_pylist(), b.column(2)
            h, at, doc, least, first = _windows(parts, k, anchor)
            keep = np.zeros(len(at), bool)
            ends = np.searchsorted(doc, np.arange(len(rows) + 1))
            for d, i in enumerate(rows):
                s = shared[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                a, e = ends[d], ends[d + 1]
                keep[a:e] = np.isin(least[a:e], s)
            at, doc = at[keep], doc[keep]
            if not len(at):
                continue
            own, edge = np.array([ids[i] for i in rows], np.int64), rolling(h, k)[at]
            # one row for an edge and a document, however often it is repeated there; place: twice the first start, odd if repeated
            one, more = _firsts(doc, edge)
            at, doc, edge = at[one], doc[one], edge[one]
            yield pa.RecordBatch.from_arrays([pa.array(own[doc]), pa.array(((at - first[doc]) * 2 + more).astype(np.int32)), pa.array(edge.view(np.int64))], names=["doc_id", "place", "edge"])

    return run


def _digest(words: list[bytes], a: int, n: int) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words[a : a + n]))


def _source_digests(batches):
    for b in batches:
        out = [[], [], [], []]
        for key, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            words = (t.as_py() or b"").split()
            for s in spans.as_py():
                for column, x in zip(out, (key, s["src_pos"], s["words"], _digest(words, s["src_pos"], s["words"]))):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["src_doc", "src_pos", "words", "digest"])


def _repeats(words: list[bytes], known: list[int], k: int, hashes: WordHash) -> list[int]:
    """Starts of the windows whose words are those of one of the known windows of the same text."""
    e = rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), k)
    of = dict(zip(e[known].tolist(), known))
    return [a for a in np.flatnonzero(np.isin(e, e[known])).tolist() if words[a : a + k] == words[of[int(e[a])] : of[int(e[a])] + k]]


def _remove(k: int):
    def run(batches):
        hashes = WordHash()
        for b in batches:
            out = [[], [], [], []]
            for key, t, spans, copied in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist()):
                words = (t.as_py() or b"").split()
                n, gone = len(words), 0
                if copied and n >= k:
                    words, gone = [], n
                elif spans.is_valid:
                    drop, repeated = np.zeros(n, bool), []
                    for s in spans.as_py():
                        a, m = s["pos"], s["words"]
                        if a + m <= n and _digest(words, a, m) == s["digest"]:
                            drop[a : a + m] = True
                            if s["more"]:
                                repeated += range(a, a + m - k + 1)
                    if repeated:
                        for a in _repeats(words, repeated, k, hashes):
                            drop[a : a + k] = True
                    gone = int(drop.sum())
                    if gone:
                        words = [words[i] for i in np.flatnonzero(~drop)]
                for column, x in zip(out, (key, n, gone, b" ".join(words))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (the kept words joined by one space).

    A word goes if a window of k words over it also starts in a document with a smaller doc_id, all windows judged on
    the input. A null text has no words; texts under k words and rows with a null doc_id keep all words; rows of one
    doc_id are not copies of each other and repeated rows stay repeated; an empty table gives an empty result; other
    columns are not read.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # the only shuffle of texts: all that reads them below is one plan and uses it again
    texts = given.where("doc_id is not null").repartition(n, "doc_id")
    # exact copies first: of each text only the smallest doc_id goes through the graph
    firsts = materialize(docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.sha2(F.col(text_col), 256).alias("sha")).agg(F.min(F.col(id_col).cast("long")).alias("doc_id")).select("doc_id"))
    firsts = firsts.distinct()
    # inner joins on unique keys below: a semi join would be pushed under the shuffles, which then could not be shared
    once = texts.join(firsts, "doc_id")
    found = once.mapInArrow(_anchors(k, anchor), "doc_id long, anchor long").where("doc_id is not null and anchor is not null").repartition(n, "anchor")
    several = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = found.join(several, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    edges = once.join(shared, "doc_id").mapInArrow(_edges(k, anchor), "doc_id long, place int, edge long").where("doc_id is not null and edge is not null").repartition(n, "edge")
    source = edges.groupBy("edge").agg(F.min(F.struct("doc_id", "place")).alias("src"), F.max("doc_id").alias("last")).where("src.doc_id < last").select("edge", F.col("src.doc_id").alias("src_doc"), F.shiftright("src.place", 1).alias("src_pos"))
    again = edges.join(source, "edge").where("doc_id > src_doc").select("doc_id", "place", "src_doc", "src_pos").distinct()
    again = again.select("doc_id", F.shiftright("place", 1).alias("pos"), (F.col("place") % 2 == 1).alias("more"), "src_doc", "src_pos")
    w = Window.partitionBy("doc_id").orderBy("pos", "src_doc", "src_pos")
    follows = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("src_doc").over(w) == F.col("src_doc")) & (F.lag("src_pos").over(w) == F.col("src_pos") - 1)
    paths = again.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = paths.groupBy("doc_id", "path").agg(F.min("pos").alias("pos"), F.first("src_doc").alias("src_doc"), F.min("src_pos").alias("src_pos"), (F.count("*") + k - 1).cast("int").alias("words"), F.max("more").alias("more")).drop("path")
    wanted = spans.select("src_doc", "src_pos", "words").distinct().groupBy(F.col("src_doc").alias("doc_id")).agg(F.collect_list(F.struct("src_pos", "words")).alias("spans"))
    digests = texts.join(wanted, "doc_id").mapInArrow(_source_digests, "src_doc long, src_pos int, words int, digest binary").distinct()
    proven = spans.join(digests, ["src_doc", "src_pos", "words"]).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "words", "digest", "more")).alias("spans"))
    joined = texts.join(proven, "doc_id", "left").join(firsts.withColumn("own", F.lit(True)), "doc_id", "left")
    joined = joined.select("doc_id", "text", "spans", (F.col("text").isNotNull() & F.col("own").isNull()).alias("copied"))
    nameless = given.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"), F.lit(False).alias("copied"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return joined.mapInArrow(_remove(k), schema).union(nameless.mapInArrow(_remove(k), schema))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substrings": op2_substrings}
ORACLES: dict[str, str] = {}
