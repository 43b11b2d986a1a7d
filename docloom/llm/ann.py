"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every distinct vector is indexed: its nearest centroid's list,
a byte a subspace for the residual, and how far the vector lies from what its code stands for. A query goes twice: it
scores the codes of its few nearest lists with asymmetric distance tables, and the exact distances of the best give a
limit; then it probes all its lists. A code is left out only if its vector must lie beyond the limit, by the triangle
inequality, so nothing near is lost in a probed list; what is left is ranked by the exact distance of the original
vectors, in the task that holds both. Lists are packed into slices of bounded size, large lists over several; queries go
to the slices of the lists they probe, codes go nowhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Vectors in the training sample, at most so many lists, codes of a slice, queries scored at a time.
SAMPLE = 20_000
MAX_LISTS = 1024
BLOCK = 8192
QUERY_BLOCK = 1024
#: The nearest lists that give the limit, and the codes of each that are ranked for it.
FIRST, KEEP = 16, 16
#: The share of lists a query probes: measured for recall on vectors of which half have no cluster; less will do for others.
PROBE = 0.7
#: Room for rounding in the bounds of codes, as a share; pairs of query and vector compared at a time.
SLACK, PAIRS = 1e-6, 16_384
SUBSPACE = 4
SEED = 11


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.stack([np.bincount(a, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    """Centroids and codebooks; bounded by the parameters, not by the data."""

    def __init__(self, sample: np.ndarray, n: int, max_lists: int = MAX_LISTS, subspace: int = SUBSPACE):
        self.centroids = kmeans(sample, max(1, min(max_lists, math.isqrt(n), len(sample))))
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.cuts = [(i, min(i + subspace, sample.shape[1])) for i in range(0, sample.shape[1], subspace)]
        self.books = [kmeans(rest[:, a:b], min(256, len(rest))) for a, b in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and the distance of each vector from what its code stands for."""
        lists = nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        codes = np.stack([nearest(rest[:, a:b], book).astype(np.uint8) for (a, b), book in zip(self.cuts, self.books)], 1)
        off = sum(((rest[:, a:b] - book[codes[:, j]]) ** 2).sum(1) for j, ((a, b), book) in enumerate(zip(self.cuts, self.books)))
        return lists, codes, np.sqrt(off)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1) / 2 - q @ self.centroids.T
        return np.argsort(d, 1, kind="stable")[:, :n]

    def distances(self, q: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Squared, of each query to what each code of one list stands for."""
        rest, out = q - self.centroids[list_id], np.zeros((len(q), len(codes)))
        for j, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            r = rest[:, a:b]
            out += ((r**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * r @ book.T)[:, codes[:, j]]
        return out


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) without those that take no part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    return rows.where("vec_id is not null and good").drop("good")


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(a)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _encode(index):
    def run(batches):
        ix = index.value
        for b in batches:
            if b.num_rows:
                lists, codes, off = ix.encode(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), b.column(1)], names=["rep", "list", "code", "off", "v"])

    return run


def _route(index, probes, slices):
    """(query_id, q, most) batches -> a row for each slice that holds a list the query probes."""

    def run(batches):
        ix, (start, blocks) = index.value, slices
        for b in batches:
            if b.num_rows:
                rows, at = [], []
                for i, lists in enumerate(ix.probes(_matrix(b.column(1)), probes)):
                    to = np.unique(np.concatenate([np.arange(start[x], start[x] + blocks[x]) for x in lists]))
                    rows.append(np.full(len(to), i))
                    at.append(to)
                took = b.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(np.concatenate(at).astype(np.int32))], names=["query_id", "q", "most", "slice"])

    return run, "query_id long, q array<double>, most double, slice int"


def within(q: np.ndarray, x: np.ndarray, row: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (q[row], x[at]) the places of those within most[row], and their exact distances; components are added
    one after the other, as Spark's aggregate does."""
    good, scores = [np.zeros(0, int)], [np.zeros(0)]
    for i in range(0, len(row), PAIRS):
        diff, limit = q[row[i : i + PAIRS]] - x[at[i : i + PAIRS]], most[row[i : i + PAIRS]]
        near = np.flatnonzero(~(np.einsum("ij,ij->i", diff, diff) > (limit * (1 + SLACK)) ** 2))
        d = np.zeros(len(near))
        for c in np.ascontiguousarray(diff[near].T):
            d += c * c
        d = np.sqrt(d)
        good.append(i + near[~(d > limit[near])])
        scores.append(d[~(d > limit[near])])
    return np.concatenate(good), np.concatenate(scores)


def _search(index, probes, keep, most_found):
    """Over rows sorted by slice, its codes before its queries: a query's nearest vectors of the slice, most_found at most,
    of each list those of its nearest codes (keep), or of all that may lie within its limit. A task holds one slice;
    queries stream by, however many there are."""

    def score(ix, ids, lists, c, off, x, queries):
        asked, q, most = queries.column(2).to_numpy(), _matrix(queries.column(6)), queries.column(7).to_numpy()
        rows, reps, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        probed = np.zeros((len(q), len(ix.centroids)), bool)
        np.put_along_axis(probed, ix.probes(q, probes), True, 1)
        for l in np.unique(lists):
            which, at = np.flatnonzero(probed[:, l]), np.flatnonzero(lists == l)
            if not len(which):
                continue
            at = at[np.argsort(ids[at])]
            d = ix.distances(q[which], l, c[at])
            if keep:
                near = np.argsort(d, 1, kind="stable")[:, :keep]
                row, col = np.repeat(np.arange(len(which)), near.shape[1]), near.ravel()
            else:
                far = ((q[which] - ix.centroids[l]) ** 2).sum(1)[:, None]  # tables of large values round more
                row, col = np.nonzero(~(d > ((most[which, None] + off[at]) * (1 + SLACK)) ** 2 + SLACK**2 * far))
            row = which[row]
            good, d = within(q, x, row, at[col], most)
            for column, v in zip((rows, reps, scores), (row[good], ids[at[col[good]]], d)):
                column.append(v)
        row, rep, s = map(np.concatenate, (rows, reps, scores))
        by = np.lexsort((rep, s, row))
        row = row[by]
        by = by[np.arange(len(row)) - np.searchsorted(row, row) < most_found]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (asked[np.concatenate(rows)[by]], rep[by], s[by])], names=["query_id", "rep", "score"])

    def run(batches):
        ix, now, held, codes = index.value, None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for first, end in zip(cuts, cuts[1:]):
                part, (at, kind) = b.slice(first, end - first), divmod(int(key[first]), 2)
                if at != now:
                    now, held, codes = at, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if held and codes is None:
                    texts = [x for h in held for x in h.column(4).to_pylist()]
                    ids, lists, off = (np.concatenate([h.column(n).to_numpy() for h in held]) for n in (2, 3, 5))
                    codes = ids, lists, np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1), off, np.concatenate([_matrix(h.column(6)) for h in held])
                for i in range(0, part.num_rows if held else 0, QUERY_BLOCK):
                    yield score(ix, *codes, part.slice(i, QUERY_BLOCK))

    return run, "query_id long, rep long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probe: float = PROBE, first: int = FIRST, sample: int = SAMPLE, max_lists: int = MAX_LISTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): each query's k nearest found, ties to smaller vec_id.

    queries has the columns of vectors; a query's own id is no candidate. Vectors that are null, zero, or hold null or
    non-finite components, null ids, and vectors of another than the most frequent dimension take no part; repeated
    rows count once. Fewer than k candidates give fewer rows; empty tables an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    base = valid_vectors(vectors, id_col, vector_col)
    dims = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = dims.d if dims else 1
    base = base.where(F.size("v") == dim)
    asked = valid_vectors(queries, id_col, vector_col).where(F.size("v") == dim).withColumnsRenamed({"vec_id": "query_id", "v": "q"}).dropDuplicates(["query_id"])
    asked = materialize(asked)
    # equal vectors are one entry of the index; of its ids only the k + 1 smallest can be in a result
    w = Window.partitionBy("v").orderBy("vec_id")
    ranked = base.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    members = materialize(ranked.withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))).select("rep", "vec_id", "n", "v"))
    entries = members.where("n = 1").select("rep", "v")
    n = entries.count()
    fit = entries.orderBy(F.xxhash64("rep", F.lit(SEED)), "rep").limit(sample).select("v").collect()  # a sample of bounded size
    rows = np.array([r.v for r in fit]) if fit else np.zeros((1, dim))
    index = spark.sparkContext.broadcast(Index(rows, n, max_lists))
    codes = materialize(entries.mapInArrow(_encode(index), "rep long, list int, code binary, off double, v array<double>"))
    # lists are packed into slices of BLOCK codes or fewer; larger ones take several
    n_lists = len(index.value.centroids)
    counts = {r.list: r.n for r in codes.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list: max_lists at most
    start, blocks, at, room = np.zeros(n_lists, np.int64), np.ones(n_lists, np.int64), -1, 0
    for x in range(n_lists):
        m = counts.get(x, 0)
        if m > room:
            blocks[x] = -(-m // BLOCK)
            at, room = at + 1, blocks[x] * BLOCK
        start[x], room = max(at, 0), room - m
        if blocks[x] > 1:
            at, room = at + int(blocks[x]) - 1, 0
    where = spark.createDataFrame([(x, int(start[x]), int(blocks[x])) for x in range(n_lists)], "list int, start int, blocks int")
    placed = codes.join(F.broadcast(where), "list").withColumn("slice", (F.col("start") + F.pmod(F.xxhash64("rep"), "blocks")).cast("int"))
    placed = placed.select("slice", F.lit(0).alias("kind"), F.col("rep").alias("id"), "list", "code", "off", F.col("v").alias("q"), F.lit(None).cast("double").alias("most"))

    def scored(given, probes, keep):
        routed = given.mapInArrow(*_route(index, probes, (start, blocks)))
        routed = routed.select("slice", F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("off"), "q", "most")
        return placed.union(routed).repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(*_search(index, probes, keep, k + 1))

    nearest_found = lambda found: found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "rep")))
    # the query itself may be among them, so the limit is the distance of one more
    nth = nearest_found(scored(asked.withColumn("most", F.lit(float("inf"))), min(n_lists, first), KEEP)).where(F.col("r") == k + 1)
    limits = materialize(asked.join(nth.select("query_id", "score"), "query_id", "left").select("query_id", "q", F.coalesce("score", F.lit(float("inf"))).alias("most")))
    top = nearest_found(scored(limits, min(n_lists, max(first, math.ceil(probe * n_lists))), 0)).where(F.col("r") <= k + 1)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = top.join(members.select("rep", "vec_id"), "rep").where("vec_id <> query_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op1_ivfpq": op1_ivfpq}
ORACLES: dict[str, str] = {}
