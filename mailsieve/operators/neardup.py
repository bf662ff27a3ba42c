"""Near-duplicate removal (X2): MinHash bands find candidates, exact Jaccard decides, components by star contraction.

* A document is the set of its shingles (SHINGLE words), as 60-bit hashes from MD5, which other engines have, too.
  Its signature is, for each of ``bands * rows`` linear functions, the minimum over the set.  An Arrow task makes both
  from the normalised texts, on arrays (``shingle_set`` and ``minhash_signature`` say the same as Columns).
* Documents that share a band are candidates.  All candidate *pairs* within a band are never formed: each document is compared with the band's
  smallest one; those that are alike (Jaccard of at least THRESHOLD) are linked to it, the others go on among
  themselves with the smallest of them, until no band has two documents left.  A round does this for the LEADERS smallest
  of a band at once: which of them lead is settled among them, in order.  There is no limit to the rounds.
* The smallest documents per band are a window limit that every task applies to its own rows first; pairs are written before the
  joins that fetch the two sets, so both sides are shuffled and AQE can split a hot representative.
  Only sets of documents that still have candidates take part.

Clusters are transitive (A~B, B~C puts A and C together), the usual choice for
near-duplicate removal.  The reference documents this step but has no code.

Null text is empty; empty texts are alike.  Rows without a key are kept and compared with nothing.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.text import normalize_text, shifted_ngrams
from mailsieve.operators.components import connected_components
from mailsieve.operators.features import slices
from mailsieve.session import checkpoint_dir


SHINGLE, THRESHOLD = 5, 0.8
#: documents of a band that the others are compared with in a round: the first rounds', then the last number again and again
LEADERS = (1, 4, 16, 64, 256)
#: the linear functions are modulo a prime, with factors from this one's powers
PRIME, ROOT = 2_147_483_647, 48_271


def shingles(text, n: int = SHINGLE):
    """Word n-gram shingles of the normalised text (whole text, linear); a shorter text is its words."""
    words = F.split(normalize_text(text), " ")
    return F.array_distinct(F.when(F.size(words) >= n, shifted_ngrams(words, n, " ")).otherwise(words))


def shingle_set(text, n: int = SHINGLE):
    """The distinct shingles as 60-bit numbers."""
    return F.array_distinct(F.transform(shingles(text, n), lambda s: F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")))


def factors(num_hashes: int) -> list[tuple[int, int]]:
    """(a, b) of the functions (a * h + b) mod PRIME: consecutive powers of a root."""
    powers = [pow(ROOT, k + 1, PRIME) for k in range(2 * num_hashes)]
    return list(zip(powers[::2], powers[1::2]))


def minhash_signature(hashes, num_hashes: int = 64):
    """Array of ``num_hashes`` minima of (a * h + b) mod PRIME over the set."""
    def least(a: int, b: int):
        return F.array_min(F.transform(hashes, lambda h: (F.lit(a).cast("long") * (h % PRIME) + b) % PRIME))

    return F.array(*[least(a, b) for a, b in factors(num_hashes)])


def band_keys(sig, bands: int = 16, rows: int = 4):
    """One key per band: hash of the band index and its ``rows`` signature values."""
    return F.array(*[F.xxhash64(F.lit(b), *[sig[b * rows + r] for r in range(rows)]) for b in range(bands)])


def _hashes(text: bytes, n: int) -> np.ndarray:
    """The 60-bit numbers of a normalised text's shingles, repeats included."""
    words = text.split(b" ")
    if len(words) < n:
        digests = [md5(w).digest() for w in words]
    else:
        # a shingle is a piece of the text, as words are one space apart
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        digests = [md5(text[start:end - 1]).digest() for start, end in zip([0, *ends], ends[n - 1:])]
    return np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64) >> np.uint64(4)


def _minima(hashes: np.ndarray, starts: np.ndarray, num_hashes: int) -> np.ndarray:
    """``minhash_signature`` of neighbouring documents' hashes: one row per document, whose hashes begin at its start."""
    prime = np.uint64(PRIME)
    base = hashes % prime
    out = np.empty((len(starts), num_hashes), np.int64)
    for k, (a, b) in enumerate(factors(num_hashes)):
        x = base * np.uint64(a) + np.uint64(b)
        x -= x // prime * prime
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _sign_texts(n: int, num_hashes: int):
    """Arrow task: (key, normalised text as bytes) -> (key, set, signature), some neighbouring texts at once."""
    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end in slices(sizes):
                each = [_hashes(t, n) for t in batch.column(1).slice(first, end - first).to_pylist()]
                sig = _minima(np.concatenate(each), np.cumsum([0, *map(len, each[:-1])]), num_hashes)
                sets = [np.unique(h).astype(np.int64) for h in each]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * num_hashes), pa.array(sig.ravel()))],
                    ["key", "__set", "__sig"])

    return run


def signed_sets(df: DataFrame, key: str, text: str, shingle_n: int = SHINGLE, num_hashes: int = 64) -> DataFrame:
    """(key, __set, __sig) of every row that has a key."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), normalize_text(text).cast("binary").alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(_sign_texts(shingle_n, num_hashes), f"key {kind}, __set array<bigint>, __sig array<bigint>").withColumnRenamed("key", key)


def _leading(judged: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """(band, first) of the firsts that are like none of the band's smaller ones that lead."""
    like = judged.where("every").select(F.col("first").alias("__a"), F.col(key).alias("__b"))
    among = firsts.join(firsts.select("band", F.col("first").alias("__b")), "band").where("__b > first")
    before = among.join(like.withColumnRenamed("__a", "first"), ["first", "__b"]).groupBy("band", "__b").agg(F.collect_set("first").alias("like"))
    each = firsts.join(before.withColumnRenamed("__b", "first"), ["band", "first"], "left")
    per = each.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("first", "like"))).alias("in_order"))
    none = F.transform(F.slice("in_order", 1, 0), lambda x: x["first"])
    lead = F.aggregate("in_order", none, lambda led, x: F.when(
        F.coalesce(F.arrays_overlap(led, x["like"]), F.lit(False)), led).otherwise(F.concat(led, F.array(x["first"]))))
    return per.select("band", F.explode(lead).alias("first"))


def verified_links(sets: DataFrame, banded: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """(first, key): every document with the representatives of its bands that it is like.

    A key of several rows is like another one if any two of their sets are; it goes on unless all are.
    """
    again = banded.groupBy("band").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first < last").select("band")
    rest, links, turn = banded.join(again, "band").select(key, "band").distinct().checkpoint(), None, 0
    in_order = Window.partitionBy("band").orderBy(key)
    while True:
        # with one leader a round, this is the band's smallest document
        n = LEADERS[min(turn, len(LEADERS) - 1)]
        firsts = rest.withColumn("__rank", F.row_number().over(in_order)).where(F.col("__rank") <= n).select("band", F.col(key).alias("first")).checkpoint()
        pairs = rest.join(firsts, "band").where(F.col(key) > F.col("first")).select("band", "first", key).checkpoint()
        if pairs.isEmpty():
            return links if links is not None else pairs.select("first", key)
        if turn < 2:  # at first documents of shared bands only, then those that are not like the smallest one
            sets = sets.join(rest.select(key).distinct(), key, "left_semi").select(key, "__set").checkpoint()
        a, b = (sets.select(F.col(key).alias(k), F.col("__set").alias(f"set_{k}")) for k in ("one", "two"))
        shared = F.size(F.array_intersect("set_one", "set_two"))
        like = shared / (F.size("set_one") + F.size("set_two") - shared) >= threshold
        judged = pairs.select("first", key).distinct().join(a, F.col("first") == F.col("one")).join(b, F.col(key) == F.col("two")).select(
            "first", key, like.alias("like")).groupBy("first", key).agg(F.max("like").alias("any"), F.min("like").alias("every")).where("any").checkpoint()
        led = pairs.join(judged, ["first", key])
        if n > 1:
            firsts = _leading(judged, firsts, key).checkpoint()
            led = led.join(firsts, ["band", "first"])
        # a document goes on to the leader that all its sets are like
        until = led.groupBy("band", key).agg(F.min(F.when(F.col("every"), F.col("first"))).alias("until")).where("until IS NOT NULL")
        found = led.join(until, ["band", key], "left").where("until IS NULL OR first <= until").select("first", key).distinct().checkpoint()
        links = found if links is None else links.unionByName(found)
        over = until.select("band", key).unionByName(firsts.select("band", F.col("first").alias(key)))
        rest = rest.join(over, ["band", key], "left_anti").select(key, "band").checkpoint()
        turn += 1


def near_duplicate_clusters(df: DataFrame, key: str = "doc_id", text: str = "body_text", shingle_n: int = SHINGLE,
                            bands: int = 16, rows: int = 4, threshold: float = THRESHOLD) -> DataFrame:
    """(key, cluster) where cluster = smallest key connected through documents that are alike."""
    checkpoint_dir(df.sparkSession)
    sets = signed_sets(df, key, text, shingle_n, bands * rows).checkpoint()
    banded = sets.select(key, F.explode(band_keys(F.col("__sig"), bands, rows)).alias("band")).checkpoint()
    links = verified_links(sets.select(key, "__set"), banded, key, threshold).distinct().checkpoint()
    roots = connected_components(links, "first", key)
    return sets.select(key).distinct().join(roots.withColumnRenamed("node", key), key, "left").select(
        key, F.coalesce("root", key).alias("cluster"))


def clusters_of_bands(banded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cluster) from (key, band) rows: the smallest key reachable through shared bands."""
    first = banded.groupBy("band").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").checkpoint()
    edges = banded.join(first, "band").where(F.col(key) != F.col("first")).select("first", key)
    roots = connected_components(edges, "first", key)
    return banded.select(key).distinct().join(roots.withColumnRenamed("node", key), key, "left").select(
        key, F.coalesce("root", key).alias("cluster"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "body_text", **kw) -> DataFrame:
    """Keep the rows of the smallest key of each near-duplicate cluster."""
    c = near_duplicate_clusters(df, key, text, **kw)
    gone = c.where(F.col(key) != F.col("cluster")).select(key)
    return df.join(gone, key, "left_anti")
