"""Language ID by a linear-chain conditional random field over words.

A word's emission scores sum weights of its n-grams, of its affixes (the n-grams that touch a word boundary) and of
itself in the lexicon, all hashed to buckets; transitions between the languages of neighbouring words are learned with
them. Training sequences splice stretches of documents of different languages, so switches are seen. Forward-backward
gives each word its marginals, and a document the language with the most of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

UNKNOWN = "und"
#: The bounded training sample: documents a language, words a document.
TRAIN_DOCS = 200
TRAIN_WORDS = 150
FOLDS = 5
#: Of the way from the score of equally likely languages to 1, what a language needs. See README for what it rejects.
MARGIN = 0.15
BUCKETS = 1 << 15
_ORDERS = (1, 2, 3, 4)
_BLOCK = 32
#: Words that are labelled together, and rows of a batch that a task sends on.
_GROUP_WORDS, _ROWS = 25_000, 1024


def plain(word: bytes) -> bytes:
    """Lower-case letters of a word."""
    s = word.decode("utf-8", "replace").lower()
    return (s if s.isalpha() else "".join(c for c in s if c.isalpha())).encode()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of the words, and the word it belongs to."""
    text = b"".join(b"\x02%b\x03" % w for w in words)
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    buckets, owner = [np.array([xxhash.xxh32_intdigest(w) % BUCKETS for w in words], np.int64)], [np.arange(len(words))]
    code = np.zeros(len(b), np.uint64)
    for n in range(1, max(_ORDERS) + 1):
        code = code[: len(b) - n + 1] * np.uint64(257) + b[n - 1 :]
        if n in _ORDERS and len(code):
            same = word[: len(code)] == word[n - 1 :]
            buckets.append((((code[same] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64))
            owner.append(word[: len(code)][same])
    return np.concatenate(buckets), np.concatenate(owner)


def emissions(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    buckets, owner = features(words)
    return np.stack([np.bincount(owner, weights[buckets, k], len(words)) for k in range(weights.shape[1])], 1)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transition: np.ndarray, messages: bool = False):
    """Marginals of every word; scores: (words, labels) of documents of the given sizes (all over 0), one after the other.
    With messages: also what reaches each word from before (itself included) and from behind it, each up to a factor.

    Documents are cut into blocks that run side by side: first each block's transfer matrix, then the vectors at block
    borders, then the words in the blocks. No document is too long and none waits for another.
    """
    s = scores.shape[1]
    e = np.exp(scores - scores.max(1, keepdims=True))
    a = np.exp(transition - transition.max())
    n_blocks = -(-sizes // _BLOCK)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)[:-1]])
    doc = np.repeat(np.arange(len(sizes)), n_blocks)
    rank = np.arange(len(doc)) - first_block[doc]
    start = (np.concatenate([[0], np.cumsum(sizes)[:-1]]))[doc] + rank * _BLOCK
    length = np.minimum(_BLOCK, sizes[doc] - rank * _BLOCK)
    at = np.minimum(start[:, None] + np.arange(_BLOCK), len(e) - 1)
    real = np.arange(_BLOCK) < length[:, None]
    m = np.broadcast_to(np.eye(s), (len(doc), s, s)).copy()
    for t in range(_BLOCK):
        on = real[:, t]
        if not on.any():
            break
        x = (m[on].reshape(-1, s) @ a).reshape(-1, s, s) * e[at[on, t]][:, None, :]
        m[on] = x / x.sum((1, 2), keepdims=True)
    # vectors at the borders, from block to block of a document; rank by rank over all documents
    left, right = np.full((len(doc), s), 1.0 / s), np.full((len(doc), s), 1.0 / s)
    order = np.argsort(rank, kind="stable")
    by_rank = np.split(order, np.cumsum(np.bincount(rank))[:-1]) if len(doc) else []
    for ids in by_rank[1:]:
        v = np.einsum("bi,bij->bj", left[ids - 1], m[ids - 1])
        left[ids] = v / v.sum(1, keepdims=True)
    for ids in by_rank[:0:-1]:
        v = np.einsum("bij,bj->bi", m[ids], right[ids])
        right[ids - 1] = v / v.sum(1, keepdims=True)
    alpha = np.empty((_BLOCK, len(doc), s))
    v = left
    for t in range(_BLOCK):
        x = (v @ a) * e[at[:, t]]
        x /= x.sum(1, keepdims=True)
        v = np.where(real[:, t, None], x, v)
        alpha[t] = v
    out = np.empty_like(e)
    before, behind = (np.empty_like(e), np.empty_like(e)) if messages else (None, None)
    v = right
    for t in range(_BLOCK - 1, -1, -1):
        on = real[:, t]
        if messages:
            before[at[on, t]], behind[at[on, t]] = alpha[t][on], v[on]
        g = alpha[t][on] * v[on]
        out[at[on, t]] = g / g.sum(1, keepdims=True)
        x = (v * e[at[:, t]]) @ a.T
        x /= x.sum(1, keepdims=True)
        v = np.where(on[:, None], x, v)
    return (out, before, behind) if messages else out


def with_pairs(scores: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every word, the words that another of their document follows, and the marginals of these pairs."""
    p, before, behind = forward_backward(scores, sizes, transition, True)
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(sizes) - 1] = False
    i = np.flatnonzero(inner)
    e = np.exp(scores[i + 1] - scores[i + 1].max(1, keepdims=True))
    pair = before[i][:, :, None] * np.exp(transition - transition.max())[None] * (e * behind[i + 1])[:, None, :]
    return p, i, pair / pair.sum((1, 2), keepdims=True)


def train(samples: list[tuple[str, list[bytes]]], seed: int = 7, epochs: int = 6, length: int = 64, batch: int = 48, rate: float = 0.05) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels, weights, transitions) from (language, plain words) samples, by gradient steps on the likelihood:
    counted less expected features, and counted less expected pairs of neighbouring labels."""
    labels = sorted({lang for lang, _ in samples})
    s, rng = max(1, len(labels)), np.random.default_rng(seed)
    stretches = []
    for lang, words in samples:
        i = 0
        while i < len(words):
            n = int(rng.geometric(1 / 20))
            stretches.append((labels.index(lang), words[i : i + n]))
            i += n
    weights, trans = np.zeros((BUCKETS, s)), np.zeros((s, s))
    if s == 1 or not stretches:
        return labels, weights, trans
    g2w, g2t = np.full((BUCKETS, s), 1e-6), np.full((s, s), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(stretches))
        words = [w for k in order for w in stretches[k][1]]
        gold = np.repeat([stretches[k][0] for k in order], [len(stretches[k][1]) for k in order])
        for a in range(0, len(words), length * batch):
            w, y = words[a : a + length * batch], gold[a : a + length * batch]
            buckets, owner = features(w)
            scores = np.stack([np.bincount(owner, weights[buckets, k], len(w)) for k in range(s)], 1)
            sizes = np.full(-(-len(w) // length), length)
            sizes[-1] = len(w) - length * (len(sizes) - 1)
            p, i, pair = with_pairs(scores, sizes, trans)
            err = np.eye(s)[y] - p
            grad = np.stack([np.bincount(buckets, err[owner, k], BUCKETS) for k in range(s)], 1) / len(w)
            gt = (np.bincount(y[i] * s + y[i + 1], minlength=s * s).reshape(s, s) - pair.sum(0)) / len(w)
            g2w += grad**2
            g2t += gt**2
            weights += rate * grad / np.sqrt(g2w) - 1e-5 * weights
            trans += rate * gt / np.sqrt(g2t)
    return labels, weights, trans


def training_sample(docs: DataFrame, max_docs: int, max_words: int) -> list[tuple[str, list[bytes]]]:
    """For each language at most max_docs documents outside the held-out fold, those of the smallest hashes of their
    id in as many buckets, and at most max_words words of each, from a place that the hash picks."""
    fit = docs.where("lang is not null and text is not null and fold <> 0").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    # written first: a join with a table of known small size shuffles no texts
    picked = materialize(fit.groupBy("lang", F.pmod("h", F.lit(max_docs)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h"))
    rows = fit.join(picked, ["lang", "h"]).dropDuplicates(["lang", "h"])
    words = F.split(F.trim("text"), r"[\x20\x09-\x0D]+")
    start = F.greatest(F.lit(1), F.pmod(F.shiftrightunsigned("h", 20), F.greatest(F.size(words) - max_words, F.lit(1))) + 1)
    out = rows.select("lang", "h", F.slice(words, start.cast("int"), max_words).alias("words")).collect()  # max_docs rows a language
    return [(r.lang, [p for p in (plain(w.encode()) for w in r.words) if p]) for r in sorted(out, key=lambda r: (r.lang, r.h))]


class Words(dict):
    """Raw word -> row of its emission scores, -1 without letters; new words wait until scored together."""

    MOST = 150_000

    def __init__(self, weights):
        super().__init__()
        self.weights, self.rows, self.new, self.scores = weights, 0, [], np.zeros((0, weights.shape[1]), np.float32)

    def __missing__(self, raw: bytes) -> int:
        p = plain(raw)
        i = -1
        if p:
            i, self.rows = self.rows, self.rows + 1
            self.new.append(p)
        self[raw] = i
        return i

    def scored(self) -> np.ndarray:
        if self.new:
            self.scores = np.concatenate([self.scores, emissions(self.new, self.weights).astype(np.float32)])
            self.new = []
        return self.scores


class Labeller:
    """Predicts texts in groups of bounded size."""

    def __init__(self, labels, weights, trans):
        self.labels, self.weights, self.trans, self.words = labels, weights, trans, Words(weights)

    def group(self, texts):
        """(language, score, switches) of each text, given as its raw words."""
        if self.words.rows > self.words.MOST:
            self.words = Words(self.weights)
        ids = [np.fromiter(map(self.words.__getitem__, raw), np.int64, len(raw)) for raw in texts]
        ids = [x[x >= 0] for x in ids]
        out = [(UNKNOWN, 0.0, 0)] * len(texts)
        some = [k for k, x in enumerate(ids) if len(x)]
        if some and self.labels:
            sizes = np.array([len(ids[k]) for k in some])
            p = forward_backward(self.words.scored()[np.concatenate([ids[k] for k in some])].astype(np.float64), sizes, self.trans)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            total = np.add.reduceat(p, starts)
            best = p.argmax(1)
            change = np.concatenate([[False], best[1:] != best[:-1]])
            change[starts] = False
            switches = np.add.reduceat(change.astype(np.int64), starts)
            for k, t, x, n, c in zip(some, total.argmax(1), total, sizes, switches):
                out[k] = (self.labels[t], float(min(1.0, x[t] / n)), int(c))
        return out

    def column(self, texts):
        """Predictions of an Arrow column of texts."""
        found, held, total = [], [], 0
        for t in texts:
            raw = (t.as_py() or b"").split()
            held.append(raw)
            total += len(raw)
            if total > _GROUP_WORDS:
                found += self.group(held)
                held, total = [], 0
        return found + self.group(held)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int, max_words: int):
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold.alias("fold"))
    labels, weights, trans = train(training_sample(kept, max_docs, max_words))
    return kept, (labels, weights.astype(np.float32), trans)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS, max_words: int = TRAIN_WORDS) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score (mean marginal of that language), switches.

    Learns from documents with a language whose crc32(doc_id) mod 5 is not 0, a bounded sample of them; predicts from
    the text alone, texts of any length whole. Of languages with equal sums of marginals the first by name is taken.
    Null texts, texts without letters, and all texts if no language was given, are 'und' with score 0;
    a null doc_id is not held out and never learned from; repeated rows stay repeated; an empty table gives an empty
    result; other columns are not read.
    """
    kept, model = fit(docs, id_col, text_col, lang_col, max_docs, max_words)

    def run(batches):
        by = Labeller(*model)
        for b in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            lang, score, switches = zip(*found) if (found := by.column(b.column(1))) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64())], names=["doc_id", "held_out", "lang_pred", "score", "switches"])

    asked = kept.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"))
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, switches long")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN, max_docs: int = TRAIN_DOCS, max_words: int = TRAIN_WORDS) -> DataFrame:
    """The rows of docs whose text has a language; all columns stay. No row crosses a shuffle.

    What goes: null texts, texts without letters, all texts if no language was given, and texts whose best language has
    a mean marginal of at most 1/S + margin * (1 - 1/S) among S languages, i.e. hardly more than S equally likely
    languages have (with a single one nothing more goes).
    """
    _, model = fit(docs, id_col, text_col, lang_col, max_docs, max_words)
    at, floor = docs.columns.index(text_col), 1 / max(1, len(model[0]))
    min_score = floor + margin * (1 - floor)

    def run(batches):
        by = Labeller(*model)
        for b in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            found = by.column(b.column(at).cast(pa.binary()))
            yield b.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES = {"op9_crf": op9_crf}
ORACLES: dict[str, str] = {}
