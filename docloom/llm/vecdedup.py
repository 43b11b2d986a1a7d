"""Lloyd's algorithm on distinct quantised vectors.

Vectors become integers, equal ones become one row with its multiplicity, and the rounds run over these rows only:
every task adds up weighted integer components of its vectors by centroid, so all sums are exact and do not depend on
the order. At the end the assignments of the distinct vectors are joined back to the ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread_join, table

#: Components from here on are not clustered: a squared distance must fit 64 bits.
LIMIT = 1 << 27
_EXACT = 1 << 20


def _packed(q: np.ndarray) -> list[bytes]:
    """Each row as bytes of the smallest width that holds it; the length tells the width, so equal bytes are equal rows."""
    most = np.maximum(q.max(1), -1 - q.min(1))
    width = np.where(most < 1 << 7, 1, np.where(most < 1 << 15, 2, 4))
    kinds = {w: q.astype(f"<i{w}") for w in np.unique(width).tolist()}
    return [kinds[w][i].tobytes() for i, w in enumerate(width.tolist())]


def _unpacked(keys: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(keys), dims), np.int64)
    width = np.fromiter(map(len, keys), np.int64, len(keys)) // dims
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        out[rows] = np.frombuffer(b"".join(keys[i] for i in rows), f"<i{w}").reshape(-1, dims)
    return out


def quantised(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, key): floor(scale * x) of each component, packed; rows with another number of components, with one that
    is null or not finite, or with one beyond LIMIT are left out."""

    def run(batches):
        for b in batches:
            ids, col = b.column(0), b.column(1)
            sized = pc.fill_null(pc.equal(pc.list_value_length(col), dims), False)
            ids, col = ids.filter(sized), col.filter(sized)
            flat = col.flatten()
            x = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims) * float(scale))
            ok = (np.abs(x) < LIMIT).all(1)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array(_packed(x[ok].astype(np.int64)) if ok.any() else [], pa.binary())], names=["vec_id", "key"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(run, "vec_id long, key binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row, exact; ties go to the smaller number."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:  # all products and sums are exact as doubles
        d = (x.astype(float) ** 2).sum(1)[:, None] - 2 * (x.astype(float) @ centroids.T.astype(float)) + (centroids.astype(float) ** 2).sum(1)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def _sums(batches, centroids: np.ndarray):
    """(cluster, n, sums) of a task's weighted vectors; the sums are exact integers as decimal digits."""
    k, dims = centroids.shape
    sums, n = [[0] * dims for _ in range(k)], [0] * k
    for b in batches:
        x, w = _unpacked(b.column(0).to_pylist(), dims), b.column(1).to_numpy(zero_copy_only=False)
        best, _ = nearest(x, centroids)
        x, w = (x, w) if int(w.sum()) * max(1, int(np.abs(x).max(initial=0))) < 1 << 62 else (x.astype(object), w.astype(object))
        for c in np.unique(best).tolist():
            rows = best == c
            n[c] += int(w[rows].sum())
            sums[c] = [a + int(s) for a, s in zip(sums[c], (x[rows] * w[rows, None]).sum(0))]
    used = [c for c in range(k) if n[c]]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([n[c] for c in used], pa.int64()), pa.array([[str(s) for s in sums[c]] for c in used], pa.list_(pa.string()))], names=["cluster", "n", "sums"])


def weighted_kmeans(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance (squared, of the quantised vector), cluster_inertia, inertia,
    centroid (the cluster's final components).

    The first centroids are the k vectors with the smallest SHA-256 of `<seed>:<vec_id>`, equal ones (repeated rows) by
    their components' bytes; fewer vectors make fewer centroids. A distance tie goes to the smaller number, and an empty
    centroid stays. Vectors that are null, of another length, with a null or non-finite component, or so large that a
    squared distance would not fit 64 bits (a component beyond 2^27 after scaling) take no part. A null vec_id starts no
    centroid; its row is assigned like any other. Sums that pass 64 bits are null. No vector: no rows. Other columns
    are not read.
    """
    spark = vectors.sparkSession
    kept = quantised(vectors, id_col, vec_col, dims, scale)
    distinct = materialize(kept.groupBy("key").agg(F.count("*").alias("w")))
    starts = kept.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "key").limit(k).collect()
    centroids = _unpacked([bytes(r["key"]) for r in starts], dims)
    if len(centroids):
        for _ in range(rounds):
            parts = distinct.mapInArrow(lambda batches, c=centroids: _sums(batches, c), "cluster int, n long, sums array<string>")
            new = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims))).collect()
            centroids = centroids.copy()
            for r in new:
                centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]

    def assign(batches):
        for b in batches:
            best, d = nearest(_unpacked(b.column(0).to_pylist(), dims), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32)), pa.array(d)], names=["key", "w", "cluster", "distance"])

    assigned = distinct.limit(0).selectExpr("*", "0 AS cluster", "0L AS distance") if not len(centroids) else materialize(distinct.mapInArrow(assign, "key binary, w long, cluster int, distance long"))
    cost = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("w").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
    whole = lambda x: x if x < 1 << 63 else None
    told = spark.createDataFrame([(c, whole(cost[c]), whole(sum(cost.values())), centroids[c].tolist()) for c in sorted(cost)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    back = spread_join(kept, assigned, "key", "w", assigned.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
    return back.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op11_vecdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weighted_kmeans(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _round_sql(i: int) -> str:
    """Assignments a<i> to the centroids c<i>."""
    return f"""d{i} AS (SELECT q.vec_id, c.c, sum((q.x - c.x) * (q.x - c.x)) AS d FROM q JOIN c{i} c USING (j) GROUP BY ALL),
a{i} AS (SELECT vec_id, min(d) AS distance, arg_min(c, (d, c)) AS cluster FROM d{i} GROUP BY vec_id)"""


QUERIES = {"op11_vecdedup": op11_vecdedup}
ORACLES = {
    "op11_vecdedup": """
WITH kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
q AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS j, unnest([CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) for x in e]) AS x FROM kept),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 40),
c0 AS MATERIALIZED (SELECT s.c, q.j, q.x FROM s JOIN q USING (vec_id)),
"""
    + ",\n".join(
        _round_sql(i)
        + f""",
s{i} AS (SELECT a.cluster AS c, q.j, sum(q.x) AS t, count(*) AS n FROM a{i} a JOIN q USING (vec_id) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.j, coalesce((t - ((t % n) + n) % n) // n, c{i}.x) AS x FROM c{i} LEFT JOIN s{i} USING (c, j))"""
        for i in range(5)
    )
    + ",\n"
    + _round_sql(5)
    + """
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a5 JOIN (SELECT c AS cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c5 GROUP BY c) USING (cluster)
""",
}
