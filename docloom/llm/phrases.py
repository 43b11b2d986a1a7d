"""Phrase collocations by contiguous pattern growth, as in PrefixSpan.

Words become 64-bit codes (of language and word; a clash of two words starts anew with another seed). A first pass
counts the words exactly and the two-word prefixes in a filter of bounded size. The second pass projects the
occurrence pointers of every prefix that may be frequent: the words that follow it in its piece, up to the longest
phrase. Prefixes are dealt to tasks with all their pointers, in the order of their extensions; only a prefix with too
many for one task is shared by neighbouring ones, whose counts are added. A task grows its prefixes to the right depth
first: sorted pointers hold every extension as a run inside the run of its prefix, so a stack of the open prefixes is all
that it keeps.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, SLOT_ROWS, in_slots, materialize, slot_bits, slot_filter, slot_rows, table

#: Lower-cases A-Z and makes every end of a piece a newline, on bytes.
_PIECES = LOWER_AZ.translate(bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10))
#: Words of a stretch whose prefixes are counted, and whose pointers are projected; different words held at a time.
_FLUSH, _STRETCH, _MOST_WORDS = 1_000_000, 100_000, 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Word -> code in one language; forgets all when too large."""

    def __init__(self, lang: str, seed: int):
        self.seed = xxhash.xxh64_intdigest(lang.encode(), seed)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word, self.seed) or 1  # 0 stands for no word
        return x


def _pieces(text: bytes | None) -> list[list[bytes]]:
    return [w for p in (text or b"").translate(_PIECES).split(b"\n") if (w := p.split())]


def _encoded(pieces: list[list[bytes]], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words, whether the word's successor is in the same piece)."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    total = int(sizes.sum())
    out = np.fromiter((codes[w] for p in pieces for w in p), np.uint64, total)
    joined = np.ones(total, bool)
    joined[np.cumsum(sizes) - 1] = False
    return out, joined


def _pairs(codes: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours."""
    x = codes[:-1] * _BASE + codes[1:]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, code, word, n) of every distinct word; written."""

    def run(batches):
        langs: dict[str, tuple[Counter, _Codes]] = {}

        def rows():
            for lang, (count, codes) in langs.items():
                words = list(count)
                code = _signed(np.fromiter((codes[w] for w in words), np.uint64, len(words)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), code, pa.array([w.decode() for w in words], pa.string()), pa.array(count.values(), pa.int64())], names=["lang", "code", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang not in langs:
                    langs[lang] = Counter(), _Codes(lang, seed)
                for p in _pieces(text.as_py()):
                    langs[lang][0].update(p)
                if sum(len(c) for c, _ in langs.values()) > _MOST_WORDS:
                    yield from rows()
                    langs.clear()
        yield from rows()

    return materialize(docs.mapInArrow(run, "lang string, code long, word string, n long").groupBy("lang", "code", "word").agg(F.sum("n").alias("n")))


def _encode_batches(batches, seed: int, words: int):
    """The words of the documents in stretches of bounded size (a text is whole): (codes, whether joined to the next)."""
    langs: dict[str, _Codes] = {}
    some, size = [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            codes = langs.get(lang) or langs.setdefault(lang, _Codes(lang, seed))
            if pieces := _pieces(text.as_py()):
                some.append(_encoded(pieces, codes))
                size += len(some[-1][0])
            if size >= words:
                yield tuple(np.concatenate(x) for x in zip(*some))
                some, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*some))


def frequent_prefixes(docs: DataFrame, seed: int, min_count: int):
    """A filter of the two-word prefixes: it knows all with min_count occurrences (at most 255 are told apart), and some others."""
    most, words = min(min_count, 255), _FLUSH

    def run(batches):
        for codes, joined in _encode_batches(batches, seed, words):
            if joined.any():
                yield slot_rows(_pairs(codes)[joined[:-1]], most)

    def add(state, slots, n):
        state[slots] = np.minimum(state[slots].astype(np.uint16) + n, most)

    return slot_filter(docs.mapInArrow(run, SLOT_ROWS), add, lambda state: state >= most)


def projected(docs: DataFrame, prefixes, seed: int, longest: int) -> DataFrame:
    """Occurrence pointers (w1, .., w<longest>, n): a two-word prefix with the words after it, 0 from the end of its piece
    or the first pair that is surely rare; n equal ones of a stretch are one row."""
    names, words = [f"w{k}" for k in range(1, longest + 1)], _STRETCH

    def run(batches):
        bits = slot_bits(prefixes.value)
        for codes, joined in _encode_batches(batches, seed, words):
            on = joined.copy()
            on[:-1][joined[:-1]] = in_slots(bits, _pairs(codes)[joined[:-1]])
            at = np.flatnonzero(on)
            if not len(at):
                continue
            cols, alive = [codes[at]], np.ones(len(at), bool)
            for k in range(1, longest):
                alive = alive & on[np.minimum(at + k - 1, len(on) - 1)]
                cols.append(np.where(alive, codes[np.minimum(at + k, len(codes) - 1)], np.uint64(0)))
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            new = np.ones(len(at), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([*(_signed(c[first]) for c in cols), pa.array(np.diff(np.append(first, len(at))))], names=[*names, "n"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))


def _grown(batches, min_count: int, longest: int):
    """Depth-first growth over sorted pointers: (words, a) of each phrase that reaches min_count here, and of the phrases
    open at either end of the task's rows, which neighbouring tasks may share."""
    stack: list[tuple[tuple[int, ...], int, bool] | None] = [None] * (longest + 1)  # by length: phrase, count, open from the start
    out: list[tuple[tuple[int, ...], int]] = []

    def rows():
        got = pa.RecordBatch.from_arrays([pa.array([list(p) for p, _ in out], pa.list_(pa.int64())), pa.array([n for _, n in out], pa.int64())], names=["words", "a"])
        out.clear()
        return got

    began = False
    for b in batches:
        if not b.num_rows:
            continue
        w = np.stack([c.to_numpy() for c in b.columns[:longest]], 1)
        n = b.column(longest).to_numpy()
        new = np.zeros(len(w), bool)
        changed = w[1:] != w[:-1]
        for k in range(1, longest + 1):
            new[1:] |= changed[:, k - 1]
            if k == 1:
                continue
            starts = np.flatnonzero(new)
            starts = starts if len(starts) and starts[0] == 0 else np.insert(starts, 0, 0)
            sums = np.add.reduceat(n, starts)
            head, tail = tuple(w[0, :k].tolist()), tuple(w[-1, :k].tolist())
            first = not began
            if stack[k] is not None and stack[k][0] == head:
                sums[0] += stack[k][1]
                first = stack[k][2]
            elif stack[k] is not None and (stack[k][2] or stack[k][1] >= min_count) and stack[k][0][-1]:
                out.append(stack[k][:2])
            for j in np.flatnonzero((sums[:-1] >= min_count) & (w[starts[:-1], k - 1] != 0)).tolist():
                if j or not first:
                    out.append((tuple(w[starts[j], :k].tolist()), int(sums[j])))
            if len(starts) > 1 and first and head[-1]:
                out.append((head, int(sums[0])))
            stack[k] = tail, int(sums[-1]), first and len(starts) == 1
        began = True
        if len(out) > 10_000:
            yield rows()
    out += [s[:2] for s in stack if s is not None and s[0][-1]]
    yield rows()


def frequent_phrases(docs: DataFrame, seed: int, min_count: int, longest: int) -> DataFrame:
    """(words, a): every phrase of 2 to `longest` words with a >= min_count, as codes; written."""
    names = [f"w{k}" for k in range(1, longest + 1)]
    pointers = materialize(projected(docs, frequent_prefixes(docs, seed, min_count), seed, longest))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grown = pointers.repartitionByRange(parts, *names).sortWithinPartitions(*names).mapInArrow(lambda batches: _grown(batches, min_count, longest), "words array<long>, a long")
    return materialize(grown.groupBy("words").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count))


def _first_by_lang(scored: DataFrame, order: list, most: int, total: int) -> DataFrame:
    """The first rows of each lang with their rank; first within slices of a lang, so no task sorts a whole one."""
    slices = max(1, total // 100_000)
    sliced = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    some = sliced.withColumn("at", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("at") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("slice", "at")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 100, longest: int = 5, share: int = 100, most: int = 2000) -> DataFrame:
    """The collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A phrase of 2 to `longest` words with a >= min_count occurrences within pieces is scored by its weakest cut:
    floor(1000 * a * n / (l * r)), ties to the earliest cut. A phrase inside a longer one that has `share` per cent of its
    occurrences or more goes. The first `most` of a language stay, by score, occurrences, then phrase. A null language
    is `und`; null, empty and blank texts have no words; repeated rows count again; whole texts are read, of any length.
    Counts up to 10^15 and word totals up to 10^17 are exact. No phrases: no rows. Other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    for seed in range(8):
        words = word_counts(docs, seed)
        if words.groupBy("code").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells all words apart")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= min_count).select("lang", "code", "word", F.col("n").alias("f"))
    phrases = frequent_phrases(docs, seed, min_count, longest)
    counts = frequent.select(F.array("code").alias("part"), "f").union(phrases.select(F.col("words").alias("part"), F.col("a").alias("f")))
    # a phrase inside a longer one that takes all of it, or `share` of it
    inside = F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))")
    taken = phrases.where(F.size("words") > 2).select(F.explode(inside).alias("words"), "a").groupBy("words").agg(F.max("a").alias("most"))
    kept = materialize(phrases.join(taken, "words", "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share)).select("words", "a"))
    cuts = kept.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).selectExpr("*", "slice(words, 1, k) AS left", "slice(words, k + 1, size(words) - k) AS right")
    cuts = cuts.join(counts.selectExpr("part AS left", "f AS l"), "left").join(counts.selectExpr("part AS right", "f AS r"), "right")
    dec = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    spelled = kept.select("words", F.posexplode("words").alias("at", "code")).join(frequent.select("code", "word", "lang"), "code")
    spelled = spelled.groupBy("words").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    scored = cuts.join(spelled, "words").join(totals, "lang")
    scored = scored.withColumn("above", dec("a", 15) * dec("n", 17) * F.lit(1000).cast("decimal(4,0)")).withColumn("below", dec("l", 15) * dec("r", 15)).withColumn("score", F.expr("above div below"))
    best = scored.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), *(F.first(c).alias(c) for c in ("lang", "phrase", "a", "n")))
    best = materialize(best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    return _first_by_lang(best, [F.desc("score"), F.desc("a"), F.asc("phrase")], most, best.count()).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrases": op13_phrases}
ORACLES = {
    "op13_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[ \t]+') if x <> ''] AS ws FROM d),
t AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM p GROUP BY lang),
o AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE k <= len(ws)),
f AS MATERIALIZED (SELECT lang, ws[i:i + k - 1] AS w, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, f, k AS whole, w, unnest(range(2, k)) AS m FROM f WHERE k > 2),
s2 AS (SELECT lang, f, w, m, unnest(range(1, whole - m + 2)) AS i FROM s),
taken AS (SELECT lang, w[i:i + m - 1] AS w, max(f) AS most FROM s2 GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN taken USING (lang, w) WHERE k > 1 AND (most IS NULL OR 100 * most < 100 * f)),
c AS (SELECT lang, w, f AS a, k AS size, unnest(range(1, k)) AS k FROM kept),
x AS (SELECT c.lang, c.w, c.a, c.k, l.f AS l, r.f AS r, t.n, (1000 * CAST(c.a AS HUGEINT) * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM c JOIN t USING (lang) JOIN f l ON l.lang = c.lang AND l.w = c.w[1:c.k] JOIN f r ON r.lang = c.lang AND r.w = c.w[c.k + 1:c.size]),
b AS (SELECT *, array_to_string(w, ' ') AS phrase FROM x QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
""",
}
