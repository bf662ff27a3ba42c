"""Operator 4: quality classifier from a Kneser-Ney n-gram model of trusted text.

An interpolated modified Kneser-Ney model of characters (UTF-8 bytes, ORDER of
them) is trained on the trusted documents: counts at the highest order, continuation counts
(number of different preceding bytes) below, three discounts an order from the counts of counts.
The perplexity per byte of every document is compared with a threshold of its
language: the QUANTILE of the language's trusted documents that were held out of the training.
With few of them it is shrunk, in logarithms, towards what all languages say: of n held-out
documents the language's own quantile weighs n / (n + QUANTILE_PRIOR), the rest is its centre times the QUANTILE of
perplexity / centre over the held-out documents of all languages; the centre is the language's median, which weighs
n / (n + CENTRE_PRIOR) against the median of all.  So a few odd trusted documents move a threshold little, and no
number of documents makes a jump.  A document above its threshold is rejected.

Counts are kept, merged and looked up in shards (see gramtables); the two
lowest orders have at most 256 * 256 entries, which are summed by Spark,
finished on the driver and broadcast.  The trusted keys are joined to the documents: by broadcast
while they are at most BROADCAST_KEYS, else by a shuffle join.

Null text is empty: only its end is scored.  Null is a language; one
without held-out trusted documents has the threshold that all languages give.  Without trusted documents nothing is
rejected (the threshold is null).  Repeated rows are scored each; repeated labels count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm import gramtables as G
from mailsieve.llm.textbytes import slices

ORDER = 5
#: chosen on labelled rows outside the training, see README
QUANTILE = 0.97
CENTRE_PRIOR, QUANTILE_PRIOR = 20, 200
FOLDS, FOLD = 5, 0
BROADCAST_KEYS = 1_000_000


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more; 1/2, 1 and 3/2 where the counts of counts do not give any."""
    if min(n1, n2, n3) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


class Level:
    """Contexts of one length: counts of (context, byte), and per context the total and the mass given up."""

    def __init__(self, code: np.ndarray, count: np.ndarray, discount: np.ndarray) -> None:
        self.code, self.count = code, count
        context = code >> np.uint64(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(code) else np.zeros(0, np.int64)
        self.context = context[first]
        self.discount = discount
        self.total = np.add.reduceat(count, first) if len(code) else count
        self.free = np.add.reduceat(discount[np.minimum(count, 3)], first) if len(code) else np.zeros(0)

    def interpolate(self, code: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability of the last byte of every code, given that of the next shorter context."""
        if not len(self.code):
            return lower
        at = np.minimum(np.searchsorted(self.context, code >> np.uint64(8)), len(self.context) - 1)
        known = self.context[at] == code >> np.uint64(8)
        own = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        count = np.where(self.code[own] == code, self.count[own], 0)
        total = np.maximum(self.total[at], 1)
        seen = np.maximum(count - self.discount[np.minimum(count, 3)], 0) / total
        return np.where(known, seen + self.free[at] / total * lower, lower)


def _shorter(code: np.ndarray) -> np.ndarray:
    return ((code >> np.uint64(16)) << np.uint64(8)) | (code & np.uint64(255))


def continuation(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts one order below: in how many different codes each shorter code ends."""
    up = _shorter(code)
    order = np.argsort(up, kind="stable")
    return G.sum_by_key([up[order]], [np.ones(len(up), np.int64)])


def counts_by_order(code: np.ndarray, count: np.ndarray, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) for contexts of depth..1 bytes from the counts of a shard; 1 is only this shard's part."""
    code, count = code[count > 0], count[count > 0]
    out = {depth: (code, count)}
    for d in range(depth - 1, 0, -1):
        out[d] = continuation(out[d + 1][0])
    return out


def lowest(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Dense probabilities of (latest byte, byte) from the summed continuation counts of pairs."""
    pairs = np.zeros((256, 256), np.int64)
    pairs[code >> 8, code & 255] = count
    single = (pairs > 0).sum(0)
    d0 = discounts(*(int((single == k).sum()) for k in range(1, 5)))
    p0 = np.full(256, 1 / 256)
    if single.sum():
        p0 = np.maximum(single - d0[np.minimum(single, 3)], 0) / single.sum() + d0[np.minimum(single, 3)].sum() / single.sum() / 256
    d1 = discounts(*(int((pairs == k).sum()) for k in range(1, 5)))
    total = np.maximum(pairs.sum(1, keepdims=True), 1)
    taken = d1[np.minimum(pairs, 3)]
    p1 = np.maximum(pairs - taken, 0) / total + taken.sum(1, keepdims=True) / total * p0
    return np.where(pairs.sum(1, keepdims=True) > 0, p1, p0)


def log10_probability(code: np.ndarray, tables: dict, found: dict[int, np.ndarray], pairs: np.ndarray, depth: int) -> np.ndarray:
    latest = (code >> np.uint64(8 * depth)).astype(np.int64)
    p = pairs[latest, (code & np.uint64(255)).astype(np.int64)]
    for d in range(2, depth + 1):
        short = ((code >> np.uint64(8 * (depth - d + 1))) << np.uint64(8)) | (code & np.uint64(255))
        p = Level(*tables[d], found[d]).interpolate(short, p)
    return np.log10(p)


def perplexity(docs: DataFrame, train: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang"),
               order: int = ORDER) -> DataFrame:
    """Columns ``keep``, train, n_bytes, log10_prob and perplexity (per byte, the end included) of every document."""
    spark = docs.sparkSession
    depth = order - 1
    flat = docs.select(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    rows, asked, shards, merged = G.prepare(flat, "text", "train", depth, lower=False, with_words=False)

    def shared(batches):
        """Per shard the counts of counts of each order (key -4 * d - k) and the continuation counts of pairs."""
        for batch in batches:
            for payload in batch.column(1):
                tables = counts_by_order(*G.unpack(payload.as_py()), depth)
                key, n = (x.astype(np.int64) for x in tables[1])
                more = [(-4 * d - k, int((tables[d][1] == k + 1).sum())) for d in range(2, depth + 1) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(key, [a for a, _ in more])),
                                                  pa.array(np.append(n, [b for _, b in more]))], ["key", "n"])

    sums = merged.mapInArrow(shared, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    low = sums[sums.key >= 0]
    named = dict(zip(sums.key.tolist(), sums.n.tolist()))
    found = {d: discounts(*(named.get(-4 * d - k, 0) for k in range(4))) for d in range(2, depth + 1)}
    model = spark.sparkContext.broadcast((found, lowest(low.key.to_numpy(), low.n.to_numpy())))

    def values(batches):
        found, pairs = model.value
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                code, count = G.unpack(payload.as_py())
                value = log10_probability(code, counts_by_order(code, count, depth), found, pairs, depth)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([G.pack(code, value.astype(np.float32))], pa.binary())],
                                                 ["shard", "payload"])

    answers = G.answer(rows, merged.mapInArrow(values, "shard int, payload binary").checkpoint(), asked)

    def score(table, column, grams, _):
        out = []
        for piece in slices(column, lower=False):
            code, doc = G.gram_codes(piece, depth)
            n = len(piece.starts)
            out.append((np.bincount(doc, minlength=n) - 1, np.bincount(doc, grams[code], n)))
        size, log10 = (np.concatenate(x) for x in zip(*out))
        kept = [table.column(f"c{i}").combine_chunks() for i in range(len(keep))] + [table.column("train").combine_chunks()]
        return pa.RecordBatch.from_arrays([*kept, pa.array(size), pa.array(log10), pa.array(10 ** (-log10 / (size + 1)))],
                                          [*[f"c{i}" for i in range(len(keep))], "train", "n_bytes", "log10_prob", "perplexity"])

    kinds = ", ".join(f"c{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))
    done = G.scored(rows, answers, "text", "train", depth, shards, False, False, score,
                    f"{kinds}, train boolean, n_bytes long, log10_prob double, perplexity double")
    return done.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "train", "n_bytes", "log10_prob", "perplexity")


def language_thresholds(held: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(__lang, own: the language's threshold) and the threshold of a language without held-out documents."""
    def at(x, share):
        return F.percentile_approx(x, share, 100_000)

    def shrunk(own, n, prior, towards):
        return F.exp((n * F.ln(own) + prior * F.ln(towards)) / (n + prior))

    overall = held.agg(at("perplexity", 0.5)).first()[0]  # one row
    per = held.groupBy(F.col("lang").alias("__lang")).agg(
        at("perplexity", 0.5).alias("middle"), at("perplexity", quantile).alias("high"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("centre", shrunk(F.col("middle"), F.col("n"), CENTRE_PRIOR, F.lit(overall).cast("double")))
    spread = held.join(per, F.col("lang").eqNullSafe(F.col("__lang"))).agg(
        at(F.col("perplexity") / F.col("centre"), quantile)).first()[0]  # one row
    own = shrunk(F.col("high"), F.col("n"), QUANTILE_PRIOR, F.col("centre") * F.lit(spread).cast("double"))
    return per.select("__lang", own.alias("own")), None if overall is None else overall * spread


def classify(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang",
             quantile: float = QUANTILE) -> DataFrame:
    """key, lang, trusted, n_bytes, log10_prob, perplexity, threshold, keep for every document.

    ``trusted``: keys of trusted documents.  Of these, crc32(key) mod FOLDS = FOLD are held out to set the thresholds.
    """
    keys = trusted.select(F.col(key).alias("__trusted")).where("__trusted IS NOT NULL").distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    flat = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    marked = flat.join(keys, F.col("key") == F.col("__trusted"), "left").withColumn("trusted", F.col("__trusted").isNotNull())
    fold = F.coalesce(F.crc32(F.col("key").cast("string")) % FOLDS == FOLD, F.lit(False))
    found = perplexity(marked, F.col("trusted") & ~fold, "text", ("key", "lang", "trusted")).checkpoint()
    thresholds, everywhere = language_thresholds(found.where(F.col("trusted") & ~F.col("train")), quantile)
    judged = found.join(thresholds, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    threshold = F.coalesce(F.col("own"), F.lit(everywhere).cast("double"))
    return judged.select(F.col("key").alias(key), F.col("lang").alias(lang), "trusted", "n_bytes", "log10_prob", "perplexity",
                         threshold.alias("threshold"),
                         F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"))
