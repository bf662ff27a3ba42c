"""Operator 13: document fingerprints, bottom-k sketches of shingle hashes (DataFrame functions only).

A shingle is WORDS consecutive words (runs of anything but ASCII white space; a
shorter text is one shingle, a text without words has none).  Its hash is the first 64
bits of its MD5 as 16 hex digits, whose order as text is their order as numbers.
The sketch of a text is the K smallest distinct hashes, ascending.  Sketches of
parts merge to the sketch of the whole: the K smallest of their union.  From two sketches:

* ``resemblance``: the share of the union's K smallest that both have; exact below K shingles;
* ``distinct_count``: (K - 1) / (K-th smallest as a fraction of 2^64); exact below K shingles;
* ``containment``: resemblance x distinct count of the union / distinct count of the first.

Two texts without words are alike (1), one without words is like no other (0).

``with_next`` gives every document its successor without a window over the whole
table: narrow (key, hash) rows are ranged, the greatest of each range bounds it,
and a text goes to the range of its key (binary search in at most RANGES + 1 bounds a
shuffle partition).  The document that bounds a range goes to the following range, too, where
it is the successor of the first.  So texts are shuffled once, in ranges of equal numbers of rows.

Null text is empty, a null key comes last.  Rows of one key are ordered by their
text's hash, repeated rows follow one another.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.session import checkpoint_dir

K = 64
WORDS = 5
#: ranges of documents per shuffle partition, so that their distribution by hash is even
RANGES = 4
#: hex digits of a hash
DIGITS = 16
WORD = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles of a text."""
    def of(w: Column) -> Column:
        first = F.slice(w, 1, F.greatest(F.size(w) - (words - 1), F.lit(1)))
        # concat_ws passes over the words that a short text doesn't have
        return F.transform(first, lambda x, i: F.substring(F.md5(F.concat_ws(
            " ", x, *[F.get(w, i + k) for k in range(1, words)]).cast("binary")), 1, DIGITS))

    return _let(F.filter(F.split(F.coalesce(text, F.lit("")), WORD), lambda x: x != ""), of)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The ``k`` smallest distinct shingle hashes."""
    return F.slice(F.sort_array(F.array_distinct(shingles(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(parts: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One merged sketch per group of parts (null sketches count as empty).

    Every task keeps the ``k`` smallest hashes of a group before the shuffle, so a group of any size stays small.
    """
    each = parts.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.explode_outer(column).alias("__hash")).distinct()
    keys = [f"__{i}" for i in range(len(by))]
    order = Window.partitionBy(*keys).orderBy(F.col("__hash").asc_nulls_last())
    least = each.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)
    merged = least.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(column))
    return merged.select(*[F.col(x).alias(c) for x, c in zip(keys, by)], column)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets."""
    def of(u: Column) -> Column:
        share = F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(share)

    return _let(merge(a, b, k), of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(2.0 ** -52)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first one's shingles that the second has, too."""
    share = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def to_string(a: Column) -> Column:
    return F.array_join(a, "")


def to_sketch(fingerprint: Column) -> Column:
    """The sketch of a fingerprint string."""
    return F.regexp_extract_all(fingerprint, F.lit(".{%d}" % DIGITS), F.lit(0))


def with_next(docs: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """``key``, ``text``, ``carry`` and, as ``next_*``, text and carry of the document that follows by descending key."""
    checkpoint_dir(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("o")
    # every so many rows of a sorted partition end a range, the last one too
    rows = max(1, math.ceil(docs.count() / (RANGES * n)))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = docs.select(place).repartitionByRange(n, "o").sortWithinPartitions("o").select(
        F.spark_partition_id().alias("part"), F.floor(row / rows).alias("k"), "o")
    ends = ranged.groupBy("part", "k").agg(F.max("o").alias("end")).checkpoint()
    bounds = ends.agg(F.sort_array(F.collect_list("end")).alias("ends")).scalar()

    def part(x: Column) -> Column:
        def halve(at: Column, _) -> Column:
            mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
            before = F.get(x["ends"], mid) < x["o"]
            return F.struct(F.when(before, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(before, at["hi"]).otherwise(mid).alias("hi"))

        steps = F.sequence(F.lit(0), F.lit(math.ceil(math.log2((RANGES + 1) * n)) + 1))
        found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), (F.size(x["ends"]) - 1).alias("hi")), halve)["lo"]
        own = F.array(F.struct(found.alias("part"), F.lit(False).alias("again")))
        more = F.array(F.struct(F.pmod(found + 1, F.size(x["ends"])).alias("part"), F.lit(True).alias("again")))
        return F.when(F.get(x["ends"], found) == x["o"], F.concat(own, more)).otherwise(own)

    columns = [key, text, *carry]
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)], place, bounds.alias("ends"))
    rows = rows.withColumn("to", F.explode(_let(F.struct("ends", "o"), part)))
    rows = rows.select("*", F.col("to.part").alias("part"), F.col("to.again").alias("again"))
    # ascending, so the successor by descending key stands before
    window = Window.partitionBy("part").orderBy(F.col("again").desc(), "o.k", "o.h")
    after = [F.lag(f"__{i}").over(window).alias(f"next_{c}") for i, c in enumerate(columns) if i]
    rows = rows.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)], *after, "again")
    return rows.where(~F.col("again")).drop("again")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """key, text, ``sketch`` and ``n_shingles`` (estimated) of every document."""
    made = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    made = made.withColumn("sketch", sketch(F.col(text), k, words))
    return made.withColumn("n_shingles", F.round(distinct_count(F.col("sketch"), k)).cast("long"))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Every document beside its edited text, whose last half is the beginning of the next document, and their sketches."""
    # on the way a sketch is its bytes
    packed = fingerprints(docs, key, text, k, words).select(key, text, F.unhex(to_string(F.col("sketch"))).alias("sketch"))
    near = with_next(packed, key, text, ["sketch"])
    half = F.floor(F.length(text) / 2).cast("int")
    cut = F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - half), F.substring(F.col(f"next_{text}"), F.lit(1), half))
    string = [F.lower(F.hex(c)).alias(c) for c in ("sketch", "next_sketch")]
    near = near.select(key, F.length(text).alias("n_chars"), cut.alias("edited"), *string)
    near = near.select(key, "n_chars", "edited", *[to_sketch(F.col(c)).alias(c) for c in ("sketch", "next_sketch")])
    return near.withColumn("edited_sketch", sketch(F.col("edited"), k, words))


def digest(docs: DataFrame) -> DataFrame:
    sketches = [F.col(c) for c in ("sketch", "edited_sketch", "next_sketch")]
    return docs.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        to_string(sketches[0]).alias("fingerprint"), to_string(sketches[1]).alias("edited_fingerprint"),
        resemblance(sketches[0], sketches[1]).alias("near_edited"), resemblance(sketches[0], sketches[2]).alias("near_next"))
