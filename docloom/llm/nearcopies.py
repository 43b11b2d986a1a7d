"""Near copies by Jaccard similarity: multi-index hashing of wide SimHash fingerprints, then the complete shingle sets.

A fingerprint of BITS bits is cut into segments. Two texts of similarity 0.8 differ in about 15 of 100 bits, mostly in
those that were nearly even in both. So each text enumerates, in every segment, the small Hamming ball over its least
certain bits, and texts that share such a segment value meet. What meets is checked by the complete distance of the
fingerprints and then by the exact similarity of the shingle sets.

In a bucket a text is not paired with all others, but with its first member; near texts form clusters. A text first meets
the FIRSTS likeliest of the first members in its buckets, and the others only where that left the two in different clusters.
The members of a bucket in different clusters are compared inside tasks, so that every near pair that shares a bucket ends
in one cluster.
A cluster that holds several components of similar texts is dealt to blocks: fingerprints and shingle sets of each two
blocks meet in a task, and only links between components leave it, so no pair is written and no link is lost to the size of
a bucket or cluster.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, components, filter_of, filter_size, materialize, spread_join, without

SHINGLE, LEAST = 5, 0.8
BITS = 960
#: Of 960 bits at similarity 0.8, 154 differ with a deviation of 12; of the first 64, 10 with a deviation of 3.
MOST_BITS, MOST_LEAD = 198, 22
_STEP = 4096
#: Orders in which a bucket's members stand, one by its segment: few, so a text of a large group meets few first members in
#: all its buckets, and several, so no text is first everywhere.
ORDERS = 8
#: First members that a text meets at once, those of the nearest first word; of a large group most need no more.
FIRSTS = 8
#: Texts whose segment values are made at a time; segment values of a batch that a task sends on.
_ROWS, _SENT = 4096, 1 << 16
#: Segment values that a task sorts, about, and how many times the session's shuffle partitions they are dealt to at most.
_SORTED, _MORE = 250_000, 4
#: Members of a bucket that are compared with as many others in one task.
BLOCK = 1024
_MULTIPLY = np.random.default_rng(20).integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 values of the text's shingles, sorted; fewer words than a shingle make one."""
    words = (text or b"").translate(LOWER_AZ).split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64))


def plan(n: int) -> tuple[int, int]:
    """(bits of a segment, uncertain bits in it) for n texts: wider segments keep chance meetings rare."""
    return (24, 2) if n <= 1 << 22 else (28, 3) if n <= 1 << 26 else (32, 4)


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint as 64-bit words, how far each bit is from even) of a set of shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(found), _STEP):
        x = found[a : a + _STEP, None] * _MULTIPLY
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    margin = 2 * ones - len(found)
    return np.packbits(margin > 0, bitorder="little").view(np.int64), abs(margin)


def _set_hash(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def _sign(shingle: int, width: int, unsure: int):
    m = BITS // width

    def run(batches):
        for b in batches:
            rows = [[], [], [], []]
            for t in b.column(2):
                found = shingles(t.as_py(), shingle)
                words, margin = sketch(found)
                low = np.argsort(margin[: m * width].reshape(m, width), 1, kind="stable")[:, :unsure]
                for column, x in zip(rows, (_set_hash(found), words, low.astype(np.uint8).tobytes(), len(found))):
                    column.append(x)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(rows, kinds))], names=["doc_id", "th", "node", "bits", "low", "n"])

    return run, "doc_id long, th long, node long, bits array<long>, low binary, n int"


def _buckets(width: int, unsure: int, later: bool):
    """Segment values of batches of (node, bits, low, n). A batch sends on one node a value, with the first word of its
    fingerprint, its size and how many it has there (not later), and pairs the others with that one and says how far their
    first words are, if they may be near (later)."""
    m = BITS // width

    weights = 1 << np.arange(width, dtype=np.int64)

    def run(batches):
        for b in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            node, sizes = b.column(0).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            words = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
            value = np.empty((len(node), m), np.int64)
            for i in range(0, len(node), 256):
                bits = np.unpackbits(words[i : i + 256].view(np.uint8), axis=1, bitorder="little")
                value[i : i + 256] = bits[:, : m * width].reshape(-1, m, width) @ weights
            low = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, m, unsure).astype(np.int64)
            ball = np.zeros((len(node), m, 1), np.int64)
            for i in range(unsure):
                ball = np.concatenate([ball, ball ^ (np.int64(1) << low[:, :, i : i + 1])], 2)
            keys = ((value[:, :, None] ^ ball) | (np.arange(m, dtype=np.int64) << width)[None, :, None]).ravel()
            order = np.argsort(keys, kind="stable")
            keys, row = keys[order], order // (m << unsure)
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            start = np.flatnonzero(new)
            if not later:
                count = np.diff(np.append(start, len(keys))).astype(np.int32)
                for i in range(0, len(start), _SENT):
                    part = start[i : i + _SENT]
                    one = row[part]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(node[one]), pa.array(count[i : i + _SENT]), pa.array(words[one, 0]), pa.array(sizes[one])], names=["bucket", "node", "k", "w", "n"])
                continue
            held, head = np.flatnonzero(~new), np.cumsum(new) - 1
            for i in range(0, len(held), _SENT):
                at = held[i : i + _SENT]
                x, y = row[at], row[start[head[at]]]
                near = np.minimum(sizes[x], sizes[y]) >= LEAST * np.maximum(sizes[x], sizes[y]) - 1e-9
                lead = np.bitwise_count((words[x, 0] ^ words[y, 0]).view(np.uint64)).astype(np.int32)
                near &= lead <= MOST_LEAD
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(node[x]), pa.array(node[y]), pa.array(lead, mask=~near)], names=["bucket", "node", "first", "lead"])

    return run, "bucket long, node long, first long, lead int" if later else "bucket long, node long, k int, w long, n int"


def _partitions(rows: int, usual: int) -> int:
    """Partitions for so many segment values: their sort is the largest of this step, so it gets more than usual."""
    return max(usual, min(_MORE * usual, -(-rows // _SORTED)))


def _candidates(met: DataFrame) -> DataFrame:
    """The distinct pairs (src, dst) of met (node, first, lead), with nth: the place of one end among those that the other
    meets, the nearest first word first. A node has at most one row a segment value here, whatever the buckets hold."""
    nth = F.row_number().over(Window.partitionBy("node").orderBy("lead", F.xxhash64("first")))
    placed = met.where("lead IS NOT NULL and node <> first").distinct().select("node", "first", nth.alias("nth"))
    return placed.groupBy(F.least("node", "first").alias("src"), F.greatest("node", "first").alias("dst")).agg(F.min("nth").alias("nth"))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of distinct pairs those whose complete fingerprints are near, with the distance."""
    ends = lambda x: nodes.select(F.col("node").alias(x), F.col("bits").alias(f"{x}_bits"))
    both = pairs.join(ends("src"), "src").join(ends("dst"), "dst")
    far = F.aggregate(F.zip_with("src_bits", "dst_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.select("src", "dst", far.alias("far")).where(F.col("far") <= MOST_BITS)


def _sets(shingle: int, known):
    def run(batches):
        bits = known.value
        for b in batches:
            slot = b.column(0).to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            for part in np.array_split(asked, -(-len(asked) // 500)) if len(asked) else ():
                found = [shingles(t.as_py(), shingle) for t in b.column(1).take(pa.array(part))]
                yield pa.RecordBatch.from_arrays([pa.array(map(_set_hash, found), pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["set", "found"])

    return run, "set long, found array<long>"


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) of similarity LEAST or more."""
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("found").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("found").alias("b")), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= LEAST * (F.size("a") + F.size("b") - shared) - 1e-9).select("src", "dst")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components; a node without a row is its own."""
    a, b = comp.select(F.col("node").alias("src"), F.col("component").alias("ca")), comp.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    both = pairs.join(a, "src", "left").join(b, "dst", "left")
    return both.where(F.coalesce("ca", "src") != F.coalesce("cb", "dst")).select(pairs.columns)


def _compare(group: pa.Table) -> pa.Table:
    """The pairs of one block pair of a bucket: of different components, of sizes that allow the similarity, and near."""
    column = lambda c: group.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    node, comp, n, side = column("node"), column("component"), column("n").astype(np.float64), column("side")
    # unsigned, as numpy counts the bits of a negative number's absolute value
    bits = group.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(node), -1)
    a, b = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    lead = np.bitwise_count(bits[a, None, 0] ^ bits[None, b, 0]) <= MOST_LEAD
    lead &= np.minimum(n[a, None], n[None, b]) >= LEAST * np.maximum(n[a, None], n[None, b]) - 1e-9
    lead &= comp[a, None] != comp[None, b]
    x, y = (i[j] for i, j in zip((a, b), np.nonzero(lead)))
    near = np.zeros(len(x), bool)
    for i in range(0, len(x), _STEP):
        part = slice(i, i + _STEP)
        near[part] = np.bitwise_count(bits[x[part]] ^ bits[y[part]]).sum(1, dtype=np.int64) <= MOST_BITS
    p, q = node[x[near]], node[y[near]]
    return pa.table({"src": np.minimum(p, q), "dst": np.maximum(p, q)})


def _members_apart(met: DataFrame, held: DataFrame, comp: DataFrame) -> DataFrame:
    """(bucket, node, component): the members of the buckets of more than two that hold several components. A bucket's rows
    meet in one place and are counted there, so no list of buckets is joined to them; a node without a component is its own."""
    rows = met.select("bucket", "node").union(met.select("bucket", "first")).union(held.select("bucket", "node")).union(held.select("bucket", "first"))
    w = Window.partitionBy("bucket")
    large = rows.repartition("bucket").distinct().withColumn("k", F.count("*").over(w)).where("k > 2").select("bucket", "node")
    own = large.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return own.withColumns({"a": F.min("component").over(w), "b": F.max("component").over(w)}).where("a < b").select("bucket", "node", "component")


def _meet_in_blocks(members: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The near pairs (src, dst) of different components in each bucket of members (bucket, node, component).

    A bucket is dealt to blocks, and each two blocks of it meet in a task of their own, so a task holds about 2 * block
    rows whatever the bucket holds; only near pairs leave it.
    """
    sized = members.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("bucket")) / block).cast("int"))
    own = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int").alias("own")
    dealt = sized.select("bucket", "node", "component", "blocks", own).join(nodes.select("node", "bits", "n"), "node")
    sent = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # side -1 and 1 are the two blocks; 0 meets itself
    sent = sent.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "node", "component", "n", "bits")
    return sent.groupBy("bucket", "lo", "hi").applyInArrow(_compare, "src long, dst long").distinct()


#: Members of a cluster that meet as many others in one task with their sets; columns of a product of sets.
SETS, _COLUMNS = 512, 4096


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, by products of 0-1 matrices over the elements that several have."""
    values = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    common = np.diff(np.append(np.flatnonzero(new), len(values))) > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(common.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((len(a) + len(b), _COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out


def _similar_of_block(group: pa.Table) -> pa.Table:
    """Links between the components of one block pair of a cluster: of its similar pairs as many as join what they join."""
    column = lambda c: group.column(c).combine_chunks()
    node, comp, n, side = (column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n", "side"))
    bits = column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(node), -1)
    a, b = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    may = (comp[a, None] != comp[None, b]) & (np.minimum(n[a, None], n[None, b]) >= LEAST * np.maximum(n[a, None], n[None, b]) - 1e-9)
    far = np.zeros(may.shape, np.uint16)
    for word in range(bits.shape[1]):
        far += np.bitwise_count(bits[a, None, word] ^ bits[None, b, word])
    may &= far <= MOST_BITS
    rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    links: list[tuple[int, int]] = []
    if len(rows):
        sets = column("found")
        read = lambda at: [sets[int(i)].values.to_numpy(zero_copy_only=False) for i in at]
        shared = _shared(read(a[rows]), read(b[cols]))
        size = n.astype(np.float64)
        total = size[a[rows]][:, None] + size[b[cols]][None] - shared
        found = may[np.ix_(rows, cols)] & (shared >= LEAST * total - 1e-9)
        root: dict[int, int] = {}

        def top(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(found)):
            x, y = a[rows[i]], b[cols[j]]
            p, q = top(int(comp[x])), top(int(comp[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(node[x]), int(node[y])))
    return pa.table({"src": pa.array([x for x, _ in links], pa.int64()), "dst": pa.array([y for _, y in links], pa.int64())})


def _similar_in_blocks(members: DataFrame, nodes: DataFrame, sets: DataFrame, block: int | None = None) -> DataFrame:
    """Links (src, dst) of similarity LEAST or more between the components of each cluster of members (cluster, k, node,
    component), k being its size; enough of them to join all that any joins.

    A cluster is dealt to blocks, and each two blocks of it meet in a task of their own with fingerprints and shingle
    sets; only links leave it.
    """
    own = F.pmod(F.xxhash64("node", "cluster"), F.col("blocks")).cast("int").alias("own")
    dealt = members.withColumn("blocks", F.ceil(F.col("k") / (block or SETS)).cast("int")).select("cluster", "node", "component", "blocks", own)
    dealt = dealt.join(nodes.select("node", "bits", "n"), "node").join(sets, "node")
    sent = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "node", "component", "n", "bits", "found")
    return sent.groupBy("cluster", "lo", "hi").applyInArrow(_similar_of_block, "src long, dst long").distinct()


def linked(nodes: DataFrame, sets_of, width: int, unsure: int) -> DataFrame:
    """Components (node, component) of the nodes (node, bits, low, n) by links of similarity LEAST or more.

    sets_of(pairs) gives the shingle sets of the pairs' ends.
    """
    given = nodes.select("node", "bits", "low", "n")
    usual = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _partitions(nodes.count() * (BITS // width << unsure), usual)
    sent = given.mapInArrow(*_buckets(width, unsure, False))
    sent = (sent.repartition(dealt, "bucket") if dealt > usual else sent.repartition("bucket")).withColumn("o", F.xxhash64("node", F.pmod(F.shiftright("bucket", width), F.lit(ORDERS))))
    w = Window.partitionBy("bucket").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    one = F.first(F.struct("node", "w", "n")).over(w)
    seen = sent.select("bucket", "node", "w", "n", one.alias("one"), F.sum("k").over(w).alias("k"))
    # most chance meetings end here, before any join
    lead = F.bit_count(F.col("w").bitwiseXOR(F.col("one.w"))).cast("int")
    may = (lead <= MOST_LEAD) & (F.least("n", "one.n") >= LEAST * F.greatest("n", "one.n") - 1e-9)
    met = materialize(seen.select("bucket", "node", F.col("one.node").alias("first"), "k", F.when(may, lead).alias("lead")).where("node <> first or k > 2"))
    held = materialize(given.mapInArrow(*_buckets(width, unsure, True)))
    pairs = materialize(_candidates(met.select("node", "first", "lead").union(held.select("node", "first", "lead"))))
    close = materialize(_close(pairs.where(F.col("nth") <= FIRSTS).select("src", "dst"), nodes))
    # first each text's nearest one; what that joins needs no further comparison
    ends = close.select(F.col("src").alias("x"), F.col("dst").alias("y"), "far").union(close.select("dst", "src", "far"))
    best = ends.groupBy("x").agg(F.min(F.struct("far", "y")).alias("b"))
    sets = materialize(sets_of(close))
    found = materialize(_similar(_ordered(best.select("x", "b.y"), "x", "y").distinct(), sets))
    comp = materialize(components(found))
    as_links = lambda c: c.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    rest = materialize(_apart(close.select("src", "dst"), comp))
    if not rest.isEmpty() and not (more := materialize(_similar(rest, sets))).isEmpty():
        comp = materialize(components(as_links(comp).union(more)))
    # texts that are near, if not similar, are in one cluster: buckets of more than two may still hold near pairs of several
    near = materialize(components(as_links(comp).union(close.select("src", "dst"))))
    later = materialize(_apart(pairs.where(F.col("nth") > FIRSTS).select("src", "dst"), near))
    if not later.isEmpty() and not (met_later := materialize(_close(later, nodes).select("src", "dst"))).isEmpty():
        near = materialize(components(as_links(near).union(met_later)))
    members = materialize(_members_apart(met, held, near))
    if not members.isEmpty() and not (late := materialize(_meet_in_blocks(members, nodes))).isEmpty():
        near = materialize(components(as_links(near).union(late)))
    # every near pair of a bucket now lies in one cluster; the similar ones of those with several components are found there
    placed = near.withColumnRenamed("component", "cluster").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed)
    open_ = materialize(placed.groupBy("cluster").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("k")).where("a < b").select("cluster", "k"))
    if open_.isEmpty():
        return comp
    asked = materialize(placed.join(open_, "cluster").select("cluster", "k", "node", "component"))
    own = materialize(sets_of(asked.select(F.col("node").alias("src"), F.col("node").alias("dst"))))
    more = materialize(_similar_in_blocks(asked, nodes, own))
    return comp if more.isEmpty() else components(as_links(comp).union(more))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, component, component_id) of every row with an id: texts are linked by a Jaccard similarity of their
    shingle sets of LEAST or more; component_id is the smallest doc_id reachable, th a hash of the text.

    Null and blank texts have the same one shingle. Texts of any length are taken whole. Every link is checked exactly;
    what can be missed is a pair that shares no segment value (README gives the measured share). Repeated rows stay
    repeated; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    width, unsure = plan(docs.count())
    text = F.col(text_col)
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    signed = materialize(given.mapInArrow(*_sign(shingle, width, unsure)))
    nodes = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("bits").alias("bits"), F.first("low").alias("low"), F.first("n").alias("n"), F.count("*").alias("k")).withColumnRenamed("node", "set").withColumn("node", F.monotonically_increasing_id()))

    def sets_of(pairs):
        """The shingle sets of the pairs' ends; of the other texts only what a filter of bounded size lets through is cut."""
        which = materialize(nodes.select("set", "node", "first").join(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), "node"))
        size = filter_size(which.count())
        bits = np.zeros(size // 8, np.uint8)
        for r in filter_of(which, F.xxhash64("first"), size).toLocalIterator():  # 8 MB at most, never ids
            bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
        known = spark.sparkContext.broadcast(bits)
        found = given.select(F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("slot"), "text").mapInArrow(*_sets(shingle, known))
        return found.join(which.select("set", "node"), "set").dropDuplicates(["node"]).select("node", "found")

    comp = linked(nodes, sets_of, width, unsure)
    named = materialize(nodes.select("set", "node", "first", "k").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    best = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("rows"))
    total = named.agg(F.count("*"), F.sum("k")).first()
    ids = materialize(spread_join(named.select(F.col("set").alias("node"), "k", "component"), best, "component", "rows", total[0]).select("node", "k", "component", "component_id"))
    return spread_join(signed.select("doc_id", "th", "node"), ids, "node", "k", total[1] or 0).select("doc_id", "th", "component", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without near copies: of each group the smallest id stays, once. Rows without an id stay.

    Where one id has several texts, each is judged by itself; of several in one group the one of the smallest hash
    stays, and of equal ones the row of the smallest hash. Texts that a filter of the ids that go lets pass cross no
    shuffle.
    """
    found = materialize(near_copies(docs, id_col, text_col, shingle).groupBy("doc_id", "th", "component", "component_id").agg(F.count("*").alias("n")))
    least = found.where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("th").alias("least"))
    judged = found.join(least, ["doc_id", "component"], "left").withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("least")))
    gone = materialize(judged.where("not stays").select("doc_id", "th"))
    kept = without(docs.where(F.col(id_col).isNotNull()), gone, [F.col(id_col).cast("long"), F.xxhash64(text_col)], ["doc_id", "th"])
    if not found.where("n > 1 and doc_id = component_id").isEmpty():
        w = Window.partitionBy(F.col(id_col), F.xxhash64(text_col)).orderBy(F.xxhash64(*docs.columns))
        kept = kept.select(*docs.columns, F.row_number().over(w).alias("__nth")).where("__nth = 1").select(docs.columns)
    return kept.union(docs.where(F.col(id_col).isNull())).select(docs.columns)
