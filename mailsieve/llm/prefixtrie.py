"""Operator 12: conversation prefix trie as minimal-perfect-hash node tables.

A node is a distinct sequence of first d turns (role, text); the root is d = 0.  Its
digest is the XOR of 128-bit hashes of (place, SHA-256 of the turn), so the digest of any
prefix comes from sums and a conversation may be cut anywhere.  Conversations are cut into
segments of SEGMENT turns; every task takes shards of segments and per shard

1. enumerates the distinct prefix digests on the segments' paths,
2. gives them slots 0..n-1 by a minimal perfect hash (levels of bit arrays; a slot counts as found only
   if the digest stored there is the one asked for),
3. scatters counts into flat arrays and
4. adds them up through the array of parent slots, deepest first.

Shards hold parts of the trie: their nodes are added up by digest.  Sums over
subtrees stay right that way, as every node's own value enters once, on the path of its
smallest member (whose shard then carries it up), and what lies in a conversation's later segments
enters at the end of its earlier ones.  Equal digests must have the same parent digest,
depth, turn hash and size in all shards, otherwise the job stops with an error; so by induction
equal digests are equal sequences.

Scale: texts are hashed where they are read.  No conversation, first turn or group of copies meets in one
task: positions come from a range sort with offsets per range, segments bound a path, a node's members are
counted per shard before the shuffle, and the members that end in a node are joined into strings of
at most MEMBERS ids, over which one task runs SHA-256 as a stream.

Turns are ordered by (turn, nulls first, then hash of role and text); null role or text is empty;
rows without conversation id belong to no conversation and are left out.  Repeated rows are turns each.
A conversation of no turns ends in the root.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.llm.textbytes import mix
from mailsieve.session import checkpoint_dir

SEGMENT = 256
MEMBERS = 256
#: path rows of a shard, about
SHARD_ROWS = 1 << 18


def numbered(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, turn_hash, bytes): every turn's place in its conversation."""
    checkpoint_dir(turns.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    flat = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(order).alias("place"), said.alias("turn_hash"), F.octet_length(text).cast("long").alias("bytes"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = flat.repartitionByRange(n, "conv", "place", "turn_hash").sortWithinPartitions("conv", "place", "turn_hash")
    ranged = ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")).checkpoint()
    parts = ranged.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return ranged.join(parts, ["conv", "part"]).select("conv", (F.col("row") + F.col("shift")).alias("pos"), "turn_hash", "bytes")


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys.

    Level by level, keys alone at their place of a bit array twice as long as the keys left are
    given the place's rank; the others go on.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.n = 0
        rest = np.arange(len(lo))
        while rest.size:
            size = max(2 * rest.size, 64)
            at = self._place(lo[rest], hi[rest], len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            rank = self.n + np.cumsum(bits) - bits
            self.levels.append((size, bits, rank))
            self.n += int(bits.sum())
            rest = rest[~bits[at]]
        slot = self._ranks(lo, hi)
        self.lo, self.hi = np.empty(self.n, np.uint64), np.empty(self.n, np.uint64)
        self.lo[slot], self.hi[slot] = lo, hi

    @staticmethod
    def _place(lo, hi, level: int, size: int) -> np.ndarray:
        return (mix(lo ^ mix(hi + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    def _ranks(self, lo, hi) -> np.ndarray:
        out = np.full(len(lo), -1, np.int64)
        todo = np.arange(len(lo))
        for level, (size, bits, rank) in enumerate(self.levels):
            at = self._place(lo[todo], hi[todo], level, size)
            found = bits[at]
            out[todo[found]] = rank[at[found]]
            todo = todo[~found]
        return out

    def slots(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 where the table doesn't have it."""
        out = self._ranks(lo, hi)
        known = out >= 0
        known[known] = (self.lo[out[known]] == lo[known]) & (self.hi[out[known]] == hi[known])
        return np.where(known, out, -1)


class _Paths:
    """The nodes on the paths of a shard's segments, one row per segment and depth (and the root on first segments)."""

    def __init__(self, batch: pa.RecordBatch, segment: int):
        seg = batch.column("seg").to_numpy().astype(np.int64)
        items = batch.column("items")
        flat = items.flatten()
        n = np.diff(np.asarray(items.offsets).astype(np.int64))
        rooted = (seg == 0).astype(np.int64)
        rows = n + rooted
        self.first = np.cumsum(rows) - rows
        #: depth of a segment's first row, and its last row
        self.top = np.where(rooted == 1, 0, seg * segment + 1)
        self.last = self.first + rows - 1
        total = int(rows.sum())
        self.seg_of = np.repeat(np.arange(len(seg)), rows)
        self.depth = np.arange(total) - np.repeat(self.first, rows) + np.repeat(self.top, rows)
        turn = self.depth > 0

        def column(name: str, kind=np.uint64) -> np.ndarray:
            out = np.zeros(total, kind)
            out[turn] = np.asarray(flat.field(name)).astype(np.int64).view(kind)
            return out

        self.size, self.turn_hash = column("bytes", np.int64), column("check")
        self.lo, self.hi, self.parent_lo, self.parent_hi = ([None] * 4)
        for name in ("lo", "hi"):
            each = column(name)
            run = np.bitwise_xor.accumulate(each) if total else each
            before = np.where(self.first > 0, run[np.maximum(self.first - 1, 0)], np.uint64(0)) if total else run
            start = batch.column(f"before_{name}").to_numpy().astype(np.int64).view(np.uint64)
            digest = run ^ np.repeat(before ^ start, rows)
            setattr(self, name, digest)
            setattr(self, f"parent_{name}", digest ^ each)
        order = np.lexsort((self.hi, self.lo))
        lo, hi = self.lo[order], self.hi[order]
        new = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) if total else np.zeros(0, bool)
        self.table = SlotTable(lo[new], hi[new])
        self.slot = self.table.slots(self.lo, self.hi)

    def one_per_slot(self, values: np.ndarray) -> np.ndarray:
        """A value that must be the same wherever a digest stands."""
        out = np.zeros(self.table.n, values.dtype)
        out[self.slot] = values
        if (out[self.slot] != values).any():
            raise ValueError("two sequences of turns share a digest")
        return out


def _shards(batches, shard_rows: int):
    """Batches of at most about ``shard_rows`` path rows."""
    for batch in batches:
        ends = np.asarray(batch.column("items").offsets).astype(np.int64)
        ends = (ends - ends[0])[1:] + np.arange(1, batch.num_rows + 1)
        at = 0
        while at < batch.num_rows:
            full = (ends[at - 1] if at else 0) + shard_rows
            stop = max(at + 1, int(np.searchsorted(ends, full, "right")))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, stop - at)]) for c in batch.columns], schema=batch.schema)
            at = stop


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


NODE_PARTS = "lo long, hi long, depth long, parent_lo long, parent_hi long, turn_hash long, size long, n long, conv long"


def _count_nodes(segment: int, shard_rows: int):
    """NODE_PARTS: per shard and digest, the members and the smallest of them."""
    def run(batches):
        for shard in _shards(batches, shard_rows):
            p = _Paths(shard, segment)
            conv = shard.column("conv").to_numpy().astype(np.int64)[p.seg_of]
            least = np.full(p.table.n, np.iinfo(np.int64).max)
            np.minimum.at(least, p.slot, conv)
            same = [p.one_per_slot(x) for x in (p.depth, p.parent_lo, p.parent_hi, p.turn_hash, p.size)]
            columns = [p.table.lo, p.table.hi, *same, np.bincount(p.slot, minlength=p.table.n).astype(np.int64), least]
            yield pa.RecordBatch.from_arrays([_signed(x) for x in columns], [x.split()[0] for x in NODE_PARTS.split(", ")])

    return run


def _sum_subtrees(segment: int, shard_rows: int):
    """(lo, hi, saved, leaves): per shard and digest, what the shard's conversations bring in from its subtree."""
    def run(batches):
        for shard in _shards(batches, shard_rows):
            p = _Paths(shard, segment)
            parent = p.table.slots(p.parent_lo, p.parent_hi)
            # later segments hand on at the end of the segment before
            parent[(p.depth == 0) | ((p.depth > 1) & (p.depth % segment == 1))] = -1
            up = np.full(p.table.n, -1)
            up[p.slot] = parent
            depth = p.one_per_slot(p.depth)
            own = shard.column("own")
            flat = own.flatten()
            of = np.repeat(np.arange(shard.num_rows), np.diff(np.asarray(own.offsets)))
            at = p.slot[p.first[of] + np.asarray(flat.field("depth")).astype(np.int64) - p.top[of]] if len(of) else np.zeros(0, np.int64)
            sums = []
            for name in ("saved", "leaves"):
                flat_sum = np.zeros(p.table.n, np.int64)
                np.add.at(flat_sum, at, np.asarray(flat.field(name)).astype(np.int64))
                np.add.at(flat_sum, p.slot[p.last], shard.column(f"later_{name}").to_numpy().astype(np.int64))
                sums.append(flat_sum)
            order = np.argsort(-depth, kind="stable")
            cut = np.flatnonzero(np.diff(depth[order])) + 1
            for level in np.split(order, cut):
                level = level[up[level] >= 0]
                for flat_sum in sums:
                    np.add.at(flat_sum, up[level], flat_sum[level])
            some = np.flatnonzero((sums[0] != 0) | (sums[1] != 0))
            columns = [p.table.lo, p.table.hi, *sums]
            yield pa.RecordBatch.from_arrays([_signed(x[some]) for x in columns], ["lo", "hi", "saved", "leaves"])

    return run


def _hash_members(batches):
    """(lo, hi, ends_sha256) of strings that come ordered by (lo, hi, chunk)."""
    key, state = None, None
    for batch in batches:
        out = []
        for lo, hi, ids in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "ids"))):
            if key != (lo, hi):
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (lo, hi), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["lo", "hi", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["lo", "hi", "ends_sha256"])


def _segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, seg, items, before_lo, before_hi, end_lo, end_hi, last): segments with the digests before and after them."""
    hashed = turns.select(
        "conv", F.floor((F.col("pos") - 1) / SEGMENT).cast("long").alias("seg"),
        F.struct("pos", F.xxhash64("turn_hash", "pos").alias("lo"), F.xxhash64("pos", "turn_hash").alias("hi"),
                 F.xxhash64("turn_hash").alias("check"), "bytes").alias("item"))
    none = convs.select("conv", F.lit(0).cast("long").alias("seg"), F.lit(None).cast(dict(hashed.dtypes)["item"]).alias("item"))
    sums = [F.coalesce(F.bit_xor(f"item.{c}"), F.lit(0).cast("long")).alias(c) for c in ("lo", "hi")]
    segments = hashed.unionByName(none).groupBy("conv", "seg").agg(F.sort_array(F.collect_list("item")).alias("items"), *sums).checkpoint()
    # only conversations of several segments need sums over them
    several = segments.where("seg > 0").select("conv").distinct()
    narrow = segments.select("conv", "seg", "lo", "hi").join(several, "conv", "left_semi")
    by = Window.partitionBy("conv").orderBy("seg")
    before = [F.bit_xor(c).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias(f"before_{c}") for c in ("lo", "hi")]
    narrow = narrow.select("conv", "seg", *before, F.lead("seg").over(by).isNull().alias("last"))
    joined = segments.join(narrow, ["conv", "seg"], "left")
    start = {c: F.coalesce(f"before_{c}", F.lit(0).cast("long")) for c in ("lo", "hi")}
    return joined.select("conv", "seg", "items", *[start[c].alias(f"before_{c}") for c in start],
                         *[start[c].bitwiseXOR(F.col(c)).alias(f"end_{c}") for c in start],
                         F.coalesce("last", F.lit(True)).alias("last")).checkpoint()


def _same(column: str):
    """The one value of a group; anything else means that a digest stands for two sequences."""
    clash = F.raise_error(F.lit("two sequences of turns share a digest")).cast("long")
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(clash).alias(column)


def trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Nodes of the prefix trie of numbered turns (``numbered``); ``convs`` (conv) adds conversations without turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    checkpoint_dir(turns.sparkSession)
    convs = turns.select("conv") if convs is None else convs
    segments = _segments(turns, convs.select("conv").distinct())
    paths = ["conv", "seg", "items", "before_lo", "before_hi"]
    parts = segments.select(*paths).mapInArrow(_count_nodes(SEGMENT, SHARD_ROWS), NODE_PARTS)
    nodes = parts.groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), *[
        _same(c) for c in ("depth", "parent_lo", "parent_hi", "turn_hash", "size")]).checkpoint()
    key = ["lo", "hi"]
    children = nodes.where("depth > 0").groupBy("parent_lo", "parent_hi").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.toDF("lo", "hi", "n_children")
    nodes = nodes.join(children, key, "left").fillna(0, ["n_children"]).checkpoint()
    # what every node itself has, on the path of its smallest member
    saved, leaf = (F.col("n") - 1) * F.col("size"), (F.col("n_children") == 0).cast("long")
    own = nodes.select("conv", F.greatest(F.floor((F.col("depth") - 1) / SEGMENT), F.lit(0)).cast("long").alias("seg"),
                       F.struct("depth", saved.alias("saved"), leaf.alias("leaves")).alias("x")).where("x.saved > 0 OR x.leaves > 0")
    own = own.groupBy("conv", "seg").agg(F.collect_list("x").alias("own"), F.sum("x.saved").alias("saved"), F.sum("x.leaves").alias("leaves")).checkpoint()
    several = segments.where("seg > 0").select("conv").distinct()
    after = Window.partitionBy("conv").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = segments.select("conv", "seg").join(several, "conv", "left_semi").join(own.drop("own"), ["conv", "seg"], "left").select(
        "conv", "seg", *[F.sum(c).over(after).alias(f"later_{c}") for c in ("saved", "leaves")])
    whole = segments.select(*paths).join(own.select("conv", "seg", "own"), ["conv", "seg"], "left").join(later, ["conv", "seg"], "left")
    whole = whole.withColumn("own", F.coalesce("own", F.array().cast(dict(own.dtypes)["own"]))).fillna(0, ["later_saved", "later_leaves"])
    sums = whole.mapInArrow(_sum_subtrees(SEGMENT, SHARD_ROWS), "lo long, hi long, saved long, leaves long").groupBy(*key).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = segments.where("last").select(F.col("end_lo").alias("lo"), F.col("end_hi").alias("hi"), "conv")
    chunk = F.floor(F.col("conv") / MEMBERS).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    ends = ends.groupBy("lo", "hi", chunk).agg(ids).repartition("lo", "hi").sortWithinPartitions("lo", "hi", "chunk")
    ends = ends.mapInArrow(_hash_members, "lo long, hi long, ends_sha256 string")
    parents = nodes.select(F.col("lo").alias("parent_lo"), F.col("hi").alias("parent_hi"), F.col("conv").alias("parent_conv_id"))
    # the root's own parent digest is the root's
    out = nodes.join(parents, ["parent_lo", "parent_hi"], "left").join(sums, key, "left").join(ends, key, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of the one whose id is the multiple of five below.

    Conversation c has the first h turns of c - c % 5, then its own after its first h, h = crc32(c) % 9.
    Returns turns and all conversations.
    """
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    h, base = F.crc32(F.col("conv").cast("string").cast("binary")) % 9, F.col("conv") - F.col("conv") % 5
    lengths = lengths.withColumn("h", h).withColumn("base", base).checkpoint()
    of_base = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = lengths.join(of_base, "base", "left").select(
        "conv", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"))
    own = turns.withColumn("h", h).where("pos > h").join(convs.select("conv", "k"), "conv").select(
        "conv", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "turn_hash", "bytes")
    first = turns.where("pos <= 8").withColumnRenamed("conv", "base").join(convs, "base").where("pos <= h")
    return own.unionByName(first.select("conv", "pos", "turn_hash", "bytes")), convs.select("conv")
