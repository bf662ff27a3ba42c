"""Operator 7: SimHash near-duplicates with a pigeonring filter.

Fingerprints: one pass over the texts; a 64-bit fingerprint bit is set where
more than half of the XXH64 values (seed 42) of the ``shingle``-word shingles
have it.  A text of fewer words is one shingle, a text of none has fingerprint 0.

Links (Hamming distance <= ``max_bits``) are sought between *different*
fingerprints; copies meet in one aggregate row before any comparison.  The 64
bits form a ring of 2 * max_bits segments with a budget of 1/2 difference each.
The pigeonring principle: a pair within the budget has a start segment from
which every chain of l consecutive segments differs in at most floor(l / 2)
bits.  So

* the first segment of the chain is equal: it is the blocking key;
* pairs of a block are dropped as soon as a chain exceeds its budget, before the
  full Hamming check;
* a block of more than ``block`` fingerprints (a large group of near copies) is
  never compared pairwise.  The chain of three segments has one difference at
  most, so one of the two next segments is equal as well: the members are
  blocked again by it, and compared where that makes small blocks.  What is still large then is linked through shared
  neighbours: two fingerprints are within 2 bits if and only if they share a
  value within 1 bit of both, so 65 rows a fingerprint link them all without a
  pair.  Work stays linear in the number of different fingerprints; no link is
  lost.

Components come from star contraction of the links (checkpointed steps).

Null text counts as empty; a null doc_id takes part but is never the smallest.
Repeated rows give repeated rows.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.llm.textbytes import SPACE_WORD, slices, words
from mailsieve.operators.components import connected_components
from mailsieve.session import checkpoint_dir

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BLOCK = 64
FP = "__fingerprint"


def _fingerprints(piece, shingle: int) -> np.ndarray:
    """Signed 64-bit fingerprints of the documents of a slice."""
    w = words(piece, SPACE_WORD)
    n_docs = len(piece.starts)
    # the words again, one space after each
    size = w.ends - w.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    inside = SPACE_WORD[piece.data]
    if len(ends):
        target = np.ones(len(joined), bool)
        target[ends] = False
        joined[target] = piece.data[inside]
    per_doc = np.diff(w.first)
    count = np.where(per_doc > 0, np.maximum(per_doc - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(n_docs), count)
    lo = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + w.first[owner]
    hi = np.minimum(lo + shingle, w.first[owner + 1]) - 1
    body, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts[lo].tolist(), ends[hi].tolist())),
                         np.uint64, len(owner))
    # per document and byte place a histogram of byte values; set bits follow from it
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    out = np.zeros((n_docs, 64), np.int64)
    for place, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
        seen = np.bincount(owner * 256 + column, minlength=n_docs * 256).reshape(n_docs, 256)
        out[:, place * 8:place * 8 + 8] = seen @ bits
    return np.packbits(2 * out > count[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and a long column ``__fingerprint``."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = [_fingerprints(piece, shingle) for piece in slices(column)]
            got = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, FP])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(FP, T.LongType(), False)]))


def _segment(fp: Column, index: Column, width: int) -> Column:
    """Segment ``index`` (mod the ring) of a fingerprint."""
    ring = 64 // width
    return F.call_function("shiftrightunsigned", fp, (F.pmod(index, F.lit(ring)) * width).cast("int")).bitwiseAND(
        F.lit((1 << width) - 1))


def _split(blocks: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of up to ``block`` members, and the members of larger ones (both checkpointed; blocks of one go)."""
    sized = blocks.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
    both = blocks.join(sized, ["i", "key"]).checkpoint()
    return both.where(F.col("n") <= block).drop("n"), both.where(F.col("n") > block).drop("n")


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(src, dst): fingerprints linked within ``max_bits``; enough links for every component.

    ``prints``: column ``fp``, each fingerprint once.  A node of the result that is no fingerprint of the
    table is a shared neighbour of two that are.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    ring = 2 * max_bits
    width = 64 // ring
    start = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(ring - 1))).alias("i"))
    first = start.select("i", _segment(F.col("fp"), F.col("i"), width).alias("key"), "fp")
    small, large = _split(first, block)

    # the chain goes on: at most one bit in the two next segments (max_bits 1: halves of the next), so one of them is equal
    if max_bits == 2:
        parts = [_segment(F.col("fp"), F.col("i") + k, width) for k in (1, 2)]
    else:
        after = _segment(F.col("fp"), F.col("i") + 1, width)
        parts = [after.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(after, 16)]
    equal = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), p.alias("part")) for k, p in enumerate(parts)])).alias("e")
    second = large.select("i", F.col("key").alias("head"), "fp", equal).select(
        "i", F.xxhash64("head", "e.k", "e.part").alias("key"), "fp")
    small2, large2 = _split(second, block)

    hot = large2.select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    near = hot.select("fp", F.explode(flips).alias("near"))
    if max_bits == 2:
        shared = near.groupBy("near").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
        through = near.join(shared, "near").where("fp <> low").select(F.col("low").alias("src"), F.col("fp").alias("dst"))
    else:  # within 1 bit: the value is a fingerprint itself
        through = near.join(hot.select(F.col("fp").alias("near")), "near").where("fp <> near").select(
            F.col("near").alias("src"), F.col("fp").alias("dst"))
    within = [_pairs(x, max_bits, ring, width) for x in (small, small2)]
    return within[0].unionByName(within[1]).unionByName(through).distinct()


def _pairs(blocks: DataFrame, max_bits: int, ring: int, width: int) -> DataFrame:
    a, b = blocks.alias("a"), blocks.alias("b")
    same = (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    joined = a.join(b, same & _ring_filter(max_bits, ring, width), "inner")
    return joined.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def _ring_filter(max_bits: int, ring: int, width: int) -> Column:
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    spent, ok = F.lit(0), F.lit(True)
    for length in range(1, ring + 1):
        spent = spent + F.bit_count(_segment(differ, F.col("a.i") + (length - 1), width))
        ok = ok & (spent <= F.lit(length * max_bits // ring))
    return ok


def _classes(marked: DataFrame, max_bits: int) -> DataFrame:
    """``marked`` (id, h, fp; checkpointed) and per row the least (id, h) of its class as ``first``."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h"))
    prints = marked.groupBy("fp").agg(F.min(order).alias("low")).checkpoint()
    found = connected_components(links(prints.select("fp"), max_bits), "src", "dst")
    rooted = prints.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("first"))
    # written, so that the join below has a shuffle on both sides and a hot fingerprint can be split
    of = rooted.select("fp", "root").join(least, "root").select("fp", "first").checkpoint()
    return marked.join(of, "fp")


def _marked(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    checkpoint_dir(docs.sparkSession)
    marked = with_fingerprint(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", shingle)
    return marked.select("id", F.xxhash64("text").alias("h"), F.col(FP).alias("fp")).checkpoint()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fingerprint long, component): component is the smallest key reachable through links, or null."""
    found = _classes(_marked(docs, text, key, shingle), max_bits)
    return found.select(F.col("id").alias(key), F.col("fp").alias("fingerprint"), F.col("first.id").alias("component"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component stays, that of the smallest key; one of repeated rows (same key and text)."""
    found = _classes(_marked(docs, text, key, shingle), max_bits)
    kept = (found.where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")))
            .groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.count(F.lit(1)).alias("__n")).checkpoint())
    rows = docs.join(kept, F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h")))
    if kept.where(F.col("__n") > 1).isEmpty():
        return rows.select(*docs.columns)
    again = rows.where(F.col("__n") > 1).dropDuplicates(["__id", "__h"])
    return rows.where(F.col("__n") == 1).unionByName(again).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))
