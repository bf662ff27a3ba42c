"""Operator 5: language-model scores by context-tree weighting over bytes.

Each byte is decomposed into its eight bits; the node of a bit is the bits of
the byte before it, in the context of the last 0..DEPTH bytes.  A node keeps how often 0 and 1
followed in the training texts; the Krichevsky-Trofimov estimate of a node is mixed
with the product of its children's weighted probabilities, half and half, from the deepest contexts
to the empty one.  The posterior weights of this mixture turn the counts into
one predictive distribution, under which every text (and its end) is scored:
log10 probability, code length in bits per byte.

The model is the table of training counts of all byte strings of DEPTH + 1
bytes, all texts, no limit; it is built, weighted and looked up in shards
(see gramtables).  Shards share two latest context bytes, so only the two
shallowest levels are common: at most 256 * 255 + 255 nodes, which are summed
by Spark, finished on the driver and broadcast.

Texts are lower-cased (A-Z) first.  Null is the empty text, which has the
probability of an immediate end.  Repeated rows count each.  A null key is held in training.
Without training texts every bit has probability 1/2.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm import gramtables as G
from mailsieve.llm.textbytes import slices

DEPTH = 5
#: a chunk has some 400,000 different words besides its n-grams, so it is smaller than for n-grams alone
CHUNK_BYTES = 16 << 20
FOLDS, FOLD = 7, 2
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    inv = 1 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of counts."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def _bit_nodes(code: np.ndarray, count: np.ndarray, level: int):
    """Nodes (context, bits before) of one bit place from sorted (context, byte) counts: keys, zeros, ones."""
    byte = code & np.uint64(255)
    node = (code & ~np.uint64(255)) | np.uint64(1 << level) | (byte >> np.uint64(8 - level))
    bit = ((byte >> np.uint64(7 - level)) & np.uint64(1)).astype(np.int64)
    if not len(node):
        return node, count, count
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    ones = np.add.reduceat(count * bit, first)
    return node[first], np.add.reduceat(count, first) - ones, ones


def _parent(code: np.ndarray) -> np.ndarray:
    """Drop the earliest context byte of (context, byte) or (context, bits)."""
    return ((code >> np.uint64(16)) << np.uint64(8)) | (code & np.uint64(255))


class Nodes:
    """The nodes of contexts of 2..depth bytes of one shard."""

    def __init__(self, code: np.ndarray, count: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.tables: dict[tuple[int, int], tuple] = {}
        code, count = code[count > 0], count[count > 0]
        for d in range(depth, 1, -1):
            for level in range(8):
                key, zeros, ones = _bit_nodes(code, count, level)
                own = log_kt(zeros, ones)
                total = own
                if d < depth:
                    child_key, _, _, child_total, _ = self.tables[d + 1, level]
                    below = np.bincount(np.searchsorted(key, _parent(child_key)), child_total, len(key))
                    total = np.logaddexp(HALF + own, HALF + below)
                    stay = np.exp(HALF + own - total)
                else:
                    stay = np.ones(len(key))
                self.tables[d, level] = key, (ones + 0.5) / (zeros + ones + 1), stay, total, (zeros, ones)
            up = _parent(code)
            order = np.argsort(up, kind="stable")
            code, count = G.sum_by_key([up[order]], [count[order]])

    def shallow(self):
        """Sums for contexts of one byte: (node key, zeros, ones, log weighted probability of the children)."""
        parts = []
        for level in range(8):
            key, _, _, total, (zeros, ones) = self.tables[2, level]
            up = _parent(key)
            distinct, back = np.unique(up, return_inverse=True)
            parts.append((distinct, *(np.bincount(back, x, len(distinct)) for x in (zeros, ones, total))))
        return [np.concatenate(x) for x in zip(*parts)]

    def log10(self, code: np.ndarray, shallow) -> np.ndarray:
        """log10 probability of the byte of every key in its context."""
        stay1, kt1, stay0, kt0 = shallow
        out = np.zeros(len(code))
        byte = code & np.uint64(255)
        for level in range(8):
            bit = ((byte >> np.uint64(7 - level)) & np.uint64(1)).astype(bool)
            bits = np.uint64(1 << level) | (byte >> np.uint64(8 - level))
            p = np.full(len(code), 0.5)
            for d in range(self.depth, 1, -1):
                key, kt, stay, _, _ = self.tables[d, level]
                node = ((code >> np.uint64(8 * (self.depth - d + 1))) << np.uint64(8)) | bits
                at = np.minimum(np.searchsorted(key, node), max(len(key) - 1, 0))
                if not len(key):
                    continue
                hit = key[at] == node
                own = np.where(bit, kt[at], 1 - kt[at])
                w = stay[at]
                p = np.where(hit, w * own + (1 - w) * p, p)
            latest = ((code >> np.uint64(8 * self.depth)) << np.uint64(8) | bits).astype(np.int64)
            p = stay1[latest] * np.where(bit, kt1[latest], 1 - kt1[latest]) + (1 - stay1[latest]) * p
            low = bits.astype(np.int64)
            p = stay0[low] * np.where(bit, kt0[low], 1 - kt0[low]) + (1 - stay0[low]) * p
            out += np.log10(p)
        return out


def shallow_weights(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
    """Weights and estimates of the contexts of one byte and of none, as dense tables."""
    z1, o1, b1 = (np.zeros(1 << 16) for _ in range(3))
    z1[key], o1[key], b1[key] = zeros, ones, below
    own = log_kt(z1, o1)
    total = np.logaddexp(HALF + own, HALF + b1)
    stay1 = np.exp(HALF + own - total)
    z0, o0, b0 = (x.reshape(256, 256).sum(0) for x in (z1, o1, np.where(z1 + o1 > 0, total, 0)))
    own0 = log_kt(z0, o0)
    stay0 = np.exp(HALF + own0 - np.logaddexp(HALF + own0, HALF + b0))
    return stay1, (o1 + 0.5) / (z1 + o1 + 1), stay0, (o0 + 0.5) / (z0 + o0 + 1)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == FOLD, F.lit(False))


def _score(docs, column, grams, tokens, depth: int, n: int, v: int):
    rows = []
    for piece in slices(column):
        code, doc = G.gram_codes(piece, depth)
        count = len(piece.starts)
        key, owner = G.word_keys(piece)
        c = tokens[key]
        end = tokens[np.array([G.END_TOKEN])][0]
        base = np.bincount(owner, np.log10((c + 1) / (n + v + 1)), count) + np.log10((end + 1) / (n + v + 1))
        rows.append((np.bincount(doc, grams[code], count), np.bincount(doc, minlength=count) - 1,
                     np.bincount(owner, minlength=count) + 1, np.bincount(owner, c > 0, count).astype(np.int64) + int(end > 0), base))
    score, size, n_tokens, n_known, base = (np.concatenate(x) for x in zip(*rows))
    return pa.RecordBatch.from_arrays(
        [docs.column("key").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(n_tokens), pa.array(n_known),
         pa.array(np.full(len(size), n, np.int64)), pa.array(base), pa.array(score), pa.array(size),
         pa.array(-score / np.log10(2) / np.maximum(size + 1, 1))],
        ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every document."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    flat = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(key).alias("held_out"))
    flat = flat.withColumn("train", ~F.col("held_out"))
    rows, asked, shards, merged = G.prepare(flat, "text", "train", depth, lower=True, with_words=True, chunk_bytes=CHUNK_BYTES)

    def shallow(batches):
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, count = G.unpack(payload.as_py())
                if shard >= shards:  # words: number of tokens and of distinct ones
                    out = [[-1], [int(count.sum())], [int((count > 0).sum())], [0.0]]
                else:
                    out = Nodes(key, count, depth).shallow()
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in zip(
                    out, (np.int64, np.int64, np.int64, np.float64))], ["node", "zeros", "ones", "below"])

    sums = merged.mapInArrow(shallow, "node long, zeros long, ones long, below double").groupBy("node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    sums = sums.toPandas()  # at most 256 * 255 nodes and the row of the words
    tokens = sums[sums.node < 0]
    n, v = (int(tokens.zeros.sum()), int(tokens.ones.sum())) if len(tokens) else (0, 0)
    nodes = sums[sums.node >= 0]
    weights = spark.sparkContext.broadcast(shallow_weights(*(nodes[x].to_numpy() for x in ("node", "zeros", "ones", "below"))))

    def values(batches):
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, count = G.unpack(payload.as_py())
                value = (count.astype(np.float64) if shard >= shards else
                         Nodes(key, count, depth).log10(key, weights.value).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([G.pack(key, value)], pa.binary())],
                                                 ["shard", "payload"])

    model = merged.mapInArrow(values, "shard int, payload binary").checkpoint()
    answers = G.answer(rows, model, asked)
    return G.scored(rows, answers, "text", "train", depth, shards, True, True,
                    lambda d, c, grams, words: _score(d, c, grams, words, depth, n, v),
                    f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                    "score double, n_bytes long, bits_per_byte double").withColumnRenamed("key", key)
