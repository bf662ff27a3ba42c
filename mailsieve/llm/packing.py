"""Operator 6: best-fit packing by a grouping genetic algorithm on islands.

Texts become token ids; a document longer than a sequence is cut into whole
sequences of ``capacity`` tokens, of which only the first piece may be shorter.  Pieces of one
length are interchangeable, so a packing is a table (bin pattern, how often):
its size depends on the number of lengths (at most ``capacity``), never on the
number of documents.  That makes the genetic algorithm global at any scale:

* a chromosome is such a table; whole groups are bins;
* crossover injects whole well-filled bins of one parent into the other, removes
  the other's bins that would use a piece twice, and best-fits the displaced
  pieces into the remaining space;
* islands are tasks with their own seeds; after each epoch their elites (bounded
  tables) move to the next island in a ring.  It ends at the lower bound
  ceil(tokens / capacity) or after EPOCHS.

Scale: texts are read once by Arrow tasks; one narrow row per piece is written.
The histogram of lengths is one aggregate of at most ``capacity`` rows.  Each
piece gets its rank among the pieces of its length from its place within its
written partition and the partition's offset, so no length (however common) is
sorted or gathered in one task; the rank then gives sequence and offset from
the broadcast table of slots.

Null text is empty: one end token.  Repeated rows are packed each for itself.
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsieve.llm.bpe import encoder
from mailsieve.session import checkpoint_dir

CAPACITY = 1024
END_ID = 2
ISLANDS = 6
POPULATION = 4
GENERATIONS = 4
EPOCHS = 3
Packing = dict[tuple[int, ...], int]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        tokens = encoder(path)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys = batch.column(0)
            rows: dict[str, list] = {x: [] for x in ("at", "piece", "start", "length", "crc", "rank", "ids")}
            for first, ids, count in tokens.batch(batch.column(1)):
                ids = np.insert(ids, np.cumsum(count), end_id).astype("<u4")
                ends = np.cumsum(count + 1)
                for i, (end, n) in enumerate(zip(ends.tolist(), (count + 1).tolist())):
                    begin = end - n
                    size = n % capacity or capacity
                    place = begin
                    for k in range(-(-n // capacity)):
                        own = ids[place:place + size].tobytes()
                        rows["at"].append(first + i)
                        rows["piece"].append(k)
                        rows["start"].append(place - begin)
                        rows["length"].append(size)
                        rows["crc"].append(zlib.crc32(own))
                        rows["rank"].append(int(seen[size]))
                        if with_ids:
                            rows["ids"].append(own)
                        seen[size] += 1
                        place += size
                        size = capacity
            at = pa.array(rows["at"], pa.int64())
            out = [keys.take(at), pa.array([part] * len(at), pa.int32()), *(
                pa.array(rows[x], t) for x, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                                                  ("crc", pa.int64()), ("rank", pa.int64())))]
            names = ["key", "part", "piece", "start", "length", "ids_crc32", "rank"]
            if with_ids:
                out.append(pa.array(rows["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


# --- the genetic algorithm, on tables (pattern -> how often) ----------------------------------------------------------

def best_fit(bins: Packing, pieces: dict[int, int], capacity: int, rng: random.Random | None = None) -> Packing:
    """Put ``pieces`` (length -> how many), longest first, into the fullest open bins that still have room."""
    room: dict[int, Packing] = {}
    for pattern, times in bins.items():
        room.setdefault(capacity - sum(pattern), {})[pattern] = times
    spaces = sorted(room)
    order = sorted(pieces, key=lambda s: -s * (1 if rng is None else rng.uniform(0.97, 1)))
    for size in order:
        left = pieces[size]
        while left > 0:
            k = bisect.bisect_left(spaces, size)
            if k == len(spaces):  # open bins, as many copies each as fit
                each = min(capacity // size, left)
                times, rest = divmod(left, each)
                for pattern, n in (((size,) * each, times), ((size,) * rest, 1 if rest else 0)):
                    if n:
                        space = capacity - sum(pattern)
                        if space not in room:
                            room[space] = {}
                            bisect.insort(spaces, space)
                        room[space][pattern] = room[space].get(pattern, 0) + n
                left = 0
                break
            space = spaces[k]
            pattern, times = next(iter(room[space].items()))
            each = min(space // size, left)
            n = min(times, left // each)
            if n == times:
                del room[space][pattern]
                if not room[space]:
                    del room[space]
                    spaces.pop(k)
            else:
                room[space][pattern] = times - n
            more = tuple(sorted((*pattern, *(size,) * each), reverse=True))
            now = capacity - sum(more)
            if now not in room:
                room[now] = {}
                bisect.insort(spaces, now)
            room[now][more] = room[now].get(more, 0) + n
            left -= n * each
    return {p: t for group in room.values() for p, t in group.items()}


def number_of_bins(packing: Packing) -> int:
    return sum(packing.values())


def _fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the squares reward concentration)."""
    return number_of_bins(packing), -sum(t * (sum(p) / capacity) ** 2 for p, t in packing.items())


def crossover(one: Packing, other: Packing, supply: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """Inject well-filled bins of ``other`` into ``one``, drop what is then used twice, best-fit the displaced pieces."""
    full = [p for p in other if sum(p) >= 0.98 * capacity] or list(other)
    inject = {p: max(1, int(other[p] * rng.uniform(0.3, 1))) for p in rng.sample(full, max(1, len(full) // 2))}
    used: Counter = Counter()
    for p, t in inject.items():
        for s in p:
            used[s] += t
    free = {s: n - used[s] for s, n in supply.items()}
    kept: Packing = {}
    for p in sorted(one, key=sum, reverse=True):  # its own bins, fullest first, while their pieces are still free
        need = Counter(p)
        t = min(one[p], min(free[s] // k for s, k in need.items()))
        if t > 0:
            kept[p] = t
            for s, k in need.items():
                free[s] -= k * t
    for p, t in inject.items():
        kept[p] = kept.get(p, 0) + t
    loose = {p: t for p, t in kept.items() if sum(p) < 0.95 * capacity}  # badly filled bins are opened as well
    for p, t in loose.items():
        del kept[p]
        for s in p:
            free[s] += t
    return best_fit(kept, {s: n for s, n in free.items() if n}, capacity, rng)


def evolve(supply: dict[int, int], capacity: int, seed: int, start: list[Packing]) -> list[Packing]:
    """One epoch on one island; returns its population, best first."""
    rng = random.Random(seed)
    bound = -(-sum(s * n for s, n in supply.items()) // capacity)
    people = list(start)
    while len(people) < POPULATION:
        people.append(best_fit({}, supply, capacity, rng if people else None))
    for _ in range(GENERATIONS):
        people.sort(key=lambda x: _fitness(x, capacity))
        if number_of_bins(people[0]) <= bound:
            break
        a, b = rng.sample(range(min(3, len(people))), 2)
        people = people[:POPULATION] + [crossover(people[a], people[b], supply, capacity, rng),
                                        crossover(people[b], people[-1], supply, capacity, rng)]
    return sorted(people, key=lambda x: _fitness(x, capacity))[:POPULATION]


def solve(spark, supply: dict[int, int], capacity: int) -> Packing:
    """The best packing of a histogram of lengths, by islands (one Spark task each) with elite migration."""
    if not supply:
        return {}
    bound = -(-sum(s * n for s, n in supply.items()) // capacity)
    elites: list[list[Packing]] = [[best_fit({}, supply, capacity)]] + [[] for _ in range(ISLANDS - 1)]
    best = elites[0][0]
    for epoch in range(EPOCHS):
        if number_of_bins(best) <= bound:
            break
        sent = spark.sparkContext.broadcast((supply, elites))

        def island(batches):
            own, people = sent.value
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    found = evolve(own, capacity, 1000 * epoch + i, people[i])[:2]
                    flat = [[[*p, -t] for p, t in x.items()] for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(flat), pa.int64()), pa.array([sum(x, []) for x in flat], pa.list_(pa.int64()))],
                        ["island", "packing"])

        seeds = spark.range(0, ISLANDS, 1, ISLANDS)
        rows = seeds.mapInArrow(island, "island long, packing array<long>").collect()
        elites = [[] for _ in range(ISLANDS)]
        for r in sorted(rows, key=lambda r: r.island):
            packing, pattern = {}, []
            for x in r.packing:
                if x < 0:
                    packing[tuple(pattern)] = -x
                    pattern = []
                else:
                    pattern.append(x)
            elites[r.island].append(packing)
            elites[(r.island + 1) % ISLANDS].append(packing)
            best = min(best, packing, key=lambda x: _fitness(x, capacity))
        sent.unpersist()
    return best


def _slots(packing: Packing, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks of its slot ranges, their first sequence and their offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: Counter = Counter()
    sequence = 0
    for pattern in sorted(packing):
        times, offset = packing[pattern], 0
        for s in pattern:
            out.setdefault(s, []).append((rank[s], sequence, offset))
            rank[s] += times
            offset += s
        sequence += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset), with ``ids`` (little-endian uint32) if asked for."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, part int, piece int, start long, length long, ids_crc32 long, rank long"
    schema += ", ids binary" * with_ids
    pieces = docs.select(key, text).mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema).checkpoint()
    per_part = pieces.groupBy("length", "part").agg(F.max("rank").alias("last"))
    supply = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum(F.col("last") + 1).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(solve(spark, supply, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("skip"))
    ranked = pieces.join(offsets.checkpoint(), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("skip")).drop("part", "skip")

    def place(batches):
        table = slots.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                mine = length == s
                first, seq, off = table[int(s)]
                j = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = seq[j] + rank[mine] - first[j], off[j]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)],
                                             [*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"{n} {t}" for n, t in ranked.dtypes)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                         *["ids"] * with_ids)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sequence from ``pack(with_ids=True)``: its ids and the documents in it, in order."""
    one = F.struct("offset", "length", F.col(key).alias("doc"), "piece", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("m")).select(
        "sequence_id", F.aggregate("m", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("m", lambda x: F.struct(x["doc"].alias("doc"), x["piece"].alias("piece"), x["offset"].alias("offset"),
                                            x["length"].alias("length"))).alias("pieces"))
