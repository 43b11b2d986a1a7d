"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Two fingerprints at most `max_bits` bits apart differ by at most
max_bits // m bits in one of m segments, so every fingerprint enumerates that small Hamming ball around each of its
segments, fetches the table entries there and keeps those whose complete distance is small enough.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, components, materialize, spread_join, table

#: A segment value with more distinct fingerprints than this is linked through shared midpoints, not by pairs.
HOT_BUCKET = 512
_STEP = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64 bits, signed: bit i is set if it is set in over half of the shingles' XXH64 values. No words: 0."""
    words = (text or b"").translate(LOWER_AZ).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _STEP):
        part = words[a : min(a + _STEP, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; a null or blank text has fingerprint 0."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def plan_segments(n: int, max_bits: int) -> int:
    """The number of segments with the least work for n fingerprints: probes plus expected chance entries met."""
    cost = {}
    for m in range(1, max_bits + 2):
        bits, r = 64 // m, max_bits // m
        ball = sum(_choose(bits, i) for i in range(r + 1))
        cost[m] = n * m * ball / 2 + n * n * m * ball / 2.0**bits
    return min(cost, key=cost.get)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _segments(m: int) -> list[tuple[int, int]]:
    ends = [round(64 * i / m) for i in range(m + 1)]
    return list(zip(ends, (b - a for a, b in zip(ends, ends[1:]))))


def _flips(width: int, radius: int) -> list[tuple[int, int]]:
    """(mask, its highest bit) of every change of up to `radius` bits in a segment."""
    out, last = [(0, 0)], [(0, 0)]
    for _ in range(radius):
        last = [(m | 1 << j, h or 1 << j) for m, h in last for j in range(((m & -m).bit_length() - 1) if m else width)]
        out += last
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values) -> Column:
    return F.expr("array(" + ",".join(f"{_signed(v)}L" if _signed(v) != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def links(nodes: DataFrame, max_bits: int = 4, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (src, dst) between the distinct fingerprints of `nodes` (fp): every pair at most max_bits apart, except
    that in buckets above hot_bucket a chain over shared midpoints stands for the pairs, with the same components."""
    m = plan_segments(nodes.count(), max_bits)
    radius = max_bits // m
    segs = _segments(m)
    key = lambda a, w: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1).cast("long"))
    entries = nodes.select("fp", F.posexplode(F.array(*(key(a, w) for a, w in segs))).alias("seg", "key"))
    # a change is enumerated only from the side that has its highest bit set, so each pair is met once a segment
    def around(i, a, w):
        flips = _flips(w, radius)
        some = F.arrays_zip(_longs(x for x, _ in flips).alias("flip"), _longs(h for _, h in flips).alias("top"))
        ball = F.filter(some, lambda x: x["flip"].eqNullSafe(F.lit(0)) | (key(a, w).bitwiseAND(x["top"]) != 0))
        return F.transform(ball, lambda x: F.struct(F.lit(i).alias("seg"), key(a, w).bitwiseXOR(x["flip"]).alias("key"), (x["flip"] == 0).alias("same")))

    probes = nodes.select(F.col("fp").alias("other"), F.explode(F.concat(*(around(i, a, w) for i, (a, w) in enumerate(segs)))).alias("p")).select("other", "p.seg", "p.key", "p.same")
    hot = materialize(entries.groupBy("seg", "key").count().where(F.col("count") > hot_bucket).select("seg", "key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    if hot.isEmpty():
        cool, full = probes, entries
    else:
        cool, full = probes.join(hot, ["seg", "key"], "left_anti"), entries.join(hot, ["seg", "key"], "left_anti")
    # probes are many times the rows that Spark sizes them by, those before the explode, so this is a merge join at every size
    a, b = full.alias("a"), cool.hint("merge").alias("b")
    pairs = a.join(b, (F.col("a.seg") == F.col("b.seg")) & (F.col("a.key") == F.col("b.key")) & near & (~F.col("same") | (F.col("fp") < F.col("other")))).select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    if hot.isEmpty():
        return pairs.distinct()
    members = entries.join(hot, ["seg", "key"], "left_semi").select("fp").union(probes.join(hot, ["seg", "key"], "left_semi").select("other")).distinct()
    return pairs.union(midpoint_links(members, max_bits)).distinct()


def midpoint_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links with the components of 'at most max_bits apart', linear in the members.

    Two fingerprints are at most 2r apart exactly if the balls of radius r around them share a point, so members of a
    point are chained to the smallest one in it. At an odd distance 2r + 1 a fingerprint lies in the ball of radius
    r + 1 around another's points at the rim only: what is 2r apart is chained as before, and two fingerprints 2r + 1
    apart share a point that is in the inner ball (r) of one and on the rim (r + 1) of the other, so in every point
    each rim member is linked to the smallest inner one; the inner ones are chained among themselves. Two rim members
    alone (2r + 2 apart) are never linked."""
    half, odd = divmod(max_bits, 2)
    inner, rim = _flips(64, half), _flips(64, half + odd)
    masks = F.arrays_zip(_longs(x for x, _ in rim).alias("flip"), F.array_repeat(F.lit(True), len(inner)).alias("inner")) if odd else F.arrays_zip(_longs(x for x, _ in inner).alias("flip"), F.array_repeat(F.lit(True), len(inner)).alias("inner"))
    ball = F.transform(masks, lambda x: F.struct(F.col("fp").bitwiseXOR(x["flip"]).alias("point"), F.coalesce(x["inner"], F.lit(False)).alias("inner")))
    points = members.select("fp", F.explode(ball).alias("p")).select("fp", "p.point", "p.inner")
    least = points.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("least"), F.min("fp").alias("first"), F.max("fp").alias("last")).where("least is not null and first <> last").select("point", "least")
    return points.join(least.hint("merge"), "point").where("fp <> least").select(F.col("fp").alias("src"), F.col("least").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row a document: doc_id, fp (long), fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle make one
    shingle; repeated rows give repeated rows; a null doc_id links nothing but gets its group's component. An empty
    table gives an empty result. Other columns are not read, so clashing names do no harm.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    comp = components(links(nodes.select("fp"), max_bits))
    # a component of fingerprints takes the smallest doc_id of its members
    named = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named.select("fp", "first", "rows", "component"))
    best = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("k"))
    ids = spread_join(named.select("fp", "rows", "component"), best, "component", "k", named.count()).select("fp", "rows", "component_id")
    # the rows of a common fingerprint (of empty texts, or of one page copied often) are joined where they lie
    return spread_join(prints, ids, "fp", "rows", prints.count()).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
