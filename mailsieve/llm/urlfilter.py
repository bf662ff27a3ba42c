"""Operator 8: URL filter by a Bloom filter cascade (DataFrame functions only).

A list of rules (host, path prefix, verdict) is encoded so that every candidate
key of the corpus is answered exactly without a join:

* A key is host + path prefix.  The candidate keys of a URL are every suffix of
  its host at a label boundary, with every path prefix of a length that the
  list has.  The key universe is all candidate keys of all URLs, distinct.
* Level 1 is a Bloom filter of the listed keys; the universe keys that pass but
  are not listed (false positives) are encoded in level 2; the listed keys that
  pass level 2 in level 3; and so on until a level has no false positives.
  A key is listed if the first level that rejects it is an even one.
* Each level is a literal of one byte a bit, looked up by position inside the
  projection, so judging is a scan without shuffle.  Only keys that pass the
  whole cascade so far come to the driver, and these shrink by the false
  positive rate at each level; a level over MAX_BITS is refused with an error
  rather than shipped.
* The listed keys that fit are then ordered: the longest wins, at equal length
  the one with the longer host.

Null urls or urls without ``://`` have empty host and path and fit no rule.
Rules with a null part are ignored; of repeated rules with different verdicts block wins.  Empty tables give empty results;
an empty list leaves every URL with the default verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.session import checkpoint_dir

BITS_PER_KEY = 16
HASHES = 4
MIN_BITS = 64
MAX_BITS = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of struct(key, host length): host suffixes x path prefixes of the given lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    per_length = []
    for n in lengths:
        fits = F.length(path) >= n
        per_length.append(F.when(fits, F.transform(suffixes, _key(F.substring(path, 1, n)))).otherwise(
            F.array().cast("array<struct<key:string,host:int>>")))
    every = F.concat(*per_length) if per_length else F.array().cast("array<struct<key:string,host:int>>")
    return F.when(F.length(host) > 0, every).otherwise(F.array().cast("array<struct<key:string,host:int>>"))


def _key(prefix: Column):
    return lambda s: F.struct(F.concat(s, prefix).alias("key"), F.length(s).alias("host"))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """HASHES positions of a key in a level, by double hashing of two independent 64-bit hashes."""
    size = F.lit(bits).cast("long")
    a, b = F.pmod(F.xxhash64(key, F.lit(level)), size), F.pmod(F.xxhash64(F.lit(level), key), size)
    return [F.pmod(a + b * i, size) for i in range(HASHES)]


def _passes(key: Column, level: int, filt: bytes) -> Column:
    one = F.lit(b"1")
    tests = [F.substring(F.lit(filt), (p + 1).cast("int"), 1) == one for p in _positions(key, level, len(filt))]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _encode(keys: DataFrame, level: int, count: int) -> bytes:
    """Bloom filter of a key column: distinct positions are made by Spark, one byte a bit."""
    bits = max(MIN_BITS, 1 << math.ceil(math.log2(max(1, count) * BITS_PER_KEY)))
    if bits > MAX_BITS:
        raise ValueError(f"level {level} of the cascade needs {bits} bits for {count} keys; the bound is {MAX_BITS}")
    filt = bytearray(b"0" * bits)
    rows = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p")).distinct()
    for (p,) in rows.toLocalIterator():
        filt[p] = 49
    return bytes(filt)


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[bytes]:
    """Filters of the levels.  ``listed`` and ``universe``: column key, distinct."""
    levels: list[bytes] = []
    inside = listed.select("key")
    outside = universe.select("key").join(inside, "key", "left_anti")
    encode, other = inside, outside
    while count := encode.count():
        filt = _encode(encode, len(levels) + 1, count)
        levels.append(filt)
        # what must be told apart next: keys of the other side that pass this level
        passed = other.where(_passes(F.col("key"), len(levels), filt)).checkpoint()
        encode, other = passed, encode
    return levels


def listed_in(key: Column, levels: list[bytes]) -> Column:
    """Exact membership of a key of the universe: true if the first rejecting level is even."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in range(len(levels), 0, -1):
        answer = F.when(_passes(key, level, levels[level - 1]), answer).otherwise(F.lit(level % 2 == 0))
    return answer


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` columns and struct ``__judged`` (host, path, rule, verdict).

    ``rules``: host, path, verdict (allow or block).  Block and allow lists have a cascade each.
    """
    checkpoint_dir(pages.sparkSession)
    host, path = split_url(F.col(url))
    named = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict")
    lengths = sorted(r.n for r in named.select("n").distinct().toLocalIterator())
    parts = pages.select(host.alias("h"), path.alias("p"))
    short = parts.select("h", F.substring("p", 1, max(lengths, default=0)).alias("p")).distinct()
    universe = short.select(F.explode(candidate_keys(F.col("h"), F.col("p"), lengths)).alias("c")).select(
        F.col("c.key").alias("key")).distinct().checkpoint()
    lists = {v: build_cascade(named.where(F.col("verdict") == v).select("key").distinct(), universe)
             for v in ("block", "allow")}
    found = pages.withColumn("__parts", F.struct(host.alias("host"), path.alias("path")))
    keys = candidate_keys(F.col("__parts.host"), F.col("__parts.path"), lengths)
    marked = F.transform(keys, lambda c: F.struct(
        F.length(c["key"]).alias("size"), c["host"].alias("host"), c["key"].alias("key"),
        F.when(listed_in(c["key"], lists["block"]), F.lit("block")).when(
            listed_in(c["key"], lists["allow"]), F.lit("allow")).alias("verdict")))
    found = found.withColumn("__best", F.array_max(F.filter(marked, lambda m: m["verdict"].isNotNull())))
    judged = F.struct(F.col("__parts.host").alias("host"), F.col("__parts.path").alias("path"),
                      F.col("__best.key").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
    return found.withColumn("__judged", judged).drop("__parts", "__best")


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", *[F.col(f"__judged.{x}").alias(x) for x in ("host", "path", "rule", "verdict")])
