"""Count tables of byte n-grams (and words) that are looked up by every document, without a row per n-gram.

Documents are packed into chunks of about CHUNK_BYTES of text.  A chunk sends one row per
shard: the sorted distinct keys of its texts and how often each occurs in its training texts.
Shards merge these (a tree of FAN rows a task), a model turns a shard's
counts into values, and each chunk gets the values of its own keys back, in its
own order.  So what is shuffled grows with the distinct keys of the chunks, a task holds
one chunk or one shard of at most FAN chunks, and nothing passes through the driver.

Chunks are made once and written to the checkpoint folder: documents and
requests of a chunk come from the same task, so a lost executor cannot mix two cuts.

An n-gram of order D (at most 6) is D context bytes and the next byte.  A text's bytes are followed by END
and preceded by START; neither byte occurs in UTF-8.  The key has the latest
context byte first, so the nodes of a context tree are prefixes of keys and all contexts with the
same two latest bytes are in one shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.textbytes import SPACE_WORD, mix, slices, span_hash, words
from mailsieve.session import checkpoint_dir

START, END = 0xFE, 0xFF
CHUNK_BYTES = 24 << 20
SHARD_BYTES = 16 << 20
FAN = 64
#: requests that one copy of a shard's model answers, at least
ANSWER_BYTES = 32 << 20
ROWS = "chunk long, shard int, salt int, payload binary"
DOCS = -1
#: key of the end token among the words
END_TOKEN = np.uint64(0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes; the first (sorted keys) as differences, by byte plane."""
    out = []
    for i, a in enumerate(arrays):
        a = np.diff(a, prepend=a.dtype.type(0)) if i == 0 and a.dtype == np.uint64 else a
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    head = np.array([len(arrays[0]), *(ord(a.dtype.char) for a in arrays)], np.int64).tobytes()
    return np.array([len(arrays)], np.int64).tobytes() + head + zstandard.compress(b"".join(out), 1)


def unpack(payload: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(payload[:8], np.int64)[0])
    n, *kinds = np.frombuffer(payload[8:16 + 8 * k], np.int64).tolist()
    body = zstandard.decompress(payload[16 + 8 * k:])
    out, at = [], 0
    for i, c in enumerate(kinds):
        kind = np.dtype(chr(c))
        planes = np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += n * kind.itemsize
        out.append(np.cumsum(a, dtype=np.uint64) if i == 0 and kind == np.uint64 else a)
    return out


def sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order].astype(np.int64)
    if not len(k):
        return k, c
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c, first)


def gram_codes(piece, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the n-gram at every position of a slice (each text's bytes and its END), and the document's index."""
    data = piece.data.copy()
    data[piece.ends] = END
    code = np.zeros(len(data), np.uint64)
    length = piece.ends - piece.starts + 1
    for k in range(1, depth + 1):
        before = np.full(len(data), START, np.uint8)
        before[k:] = data[:-k] if k < len(data) else before[k:]
        for j in range(k):  # contexts that reach before the text
            before[(piece.starts + j)[length > j]] = START
        code = (code << np.uint64(8)) | before
    return (code << np.uint64(8)) | data, np.repeat(np.arange(len(length)), length)


def word_keys(piece) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a slice (62 bits, odd) and the document's index."""
    w = words(piece, SPACE_WORD)
    key = (span_hash(piece.data, w.starts, w.ends) >> np.uint64(1)) | np.uint64(1)
    return key, np.repeat(np.arange(len(piece.starts)), np.diff(w.first))


def gram_shard(key: np.ndarray, depth: int, shards: int) -> np.ndarray:
    return (mix(key >> np.uint64(8 * (depth - 1))) % np.uint64(shards)).astype(np.int64)


def word_shard(key: np.ndarray, shards: int) -> np.ndarray:
    return shards + (mix(key) % np.uint64(shards)).astype(np.int64)


def distinct_keys(texts: pa.Array, train: np.ndarray, depth: int, shards: int, lower: bool, with_words: bool):
    """{shard: (sorted distinct keys, training counts)} of some texts."""
    grams: list = [[], []]
    tokens: list = [[], []]
    for piece in slices(texts, lower=lower):
        own = train[piece.first:piece.first + len(piece.starts)].astype(np.uint64)
        for code, doc, (keys, counts) in ((*gram_codes(piece, depth), grams), *([(*word_keys(piece), tokens)] if with_words else ())):
            if len(code):  # the flag in the lowest bit, so that one plain sort groups keys and keeps their flags
                both = (code << np.uint64(1)) | own[doc]
                both.sort()
                code = both >> np.uint64(1)
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                keys.append(code[first])
                counts.append(np.add.reduceat((both & np.uint64(1)).astype(np.int64), first))
        for keys, counts in (grams, tokens):
            if len(keys) >= 8:
                a, b = sum_by_key(keys, counts)
                keys[:], counts[:] = [a], [b]
    out = {}
    for (keys, counts), place in ((grams, lambda k: gram_shard(k, depth, shards)), (tokens, lambda k: word_shard(k, shards))):
        k, c = sum_by_key(keys, counts)
        where = place(k)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(where[order]) != 0)) if len(k) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(k)]):
            mine = order[lo:hi]
            out[int(where[mine[0]])] = (k[mine], c[mine])
    return out


def chunks(docs: DataFrame, text: str, train: str, depth: int, shards: int, lower: bool, with_words: bool,
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """ROWS: per chunk its documents (shard DOCS) and its requests (keys, counts) per shard; written."""

    def emit(batches, chunk):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = table.column(text).combine_chunks()
        flags = pc.fill_null(table.column(train), False).to_numpy().astype(bool)
        found = distinct_keys(column, flags, depth, shards, lower, with_words)
        if with_words:  # the end token of every training text
            s = int(word_shard(np.array([END_TOKEN]), shards)[0])
            k, c = found.get(s, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            found[s] = (np.insert(k, 0, END_TOKEN), np.insert(c, 0, int(flags.sum())))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
            w.write_table(table)
        rows = [(DOCS, sink.getvalue().to_pybytes())] + [(s, pack(k, c.astype(np.uint32))) for s, (k, c) in sorted(found.items())]
        del table, column, found, sink
        pa.default_memory_pool().release_unused()  # what the pool keeps counts as the worker's memory
        for shard, payload in rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([shard], pa.int32()), pa.array([0], pa.int32()),
                 pa.array([payload], pa.binary())], ["chunk", "shard", "salt", "payload"])

    def run(batches):
        from pyspark import TaskContext

        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        held, size = [], 0
        for batch in batches:
            at = 0
            length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(length)
            while at < batch.num_rows:
                base = total[at - 1] if at else 0
                end = min(max(int(np.searchsorted(total, base + chunk_bytes - size, "right")), at + 1), batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(total[end - 1] - base)
                at = end
                if size >= chunk_bytes or at < batch.num_rows:
                    yield from emit(held, chunk)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from emit(held, chunk)

    return docs.mapInArrow(run, ROWS).checkpoint()


def shard_count(docs: DataFrame, text: str) -> int:
    """Shards so that one holds the keys of about SHARD_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return min(max(8, math.ceil(size / SHARD_BYTES)), 8192)


def merge(rows: DataFrame, n_chunks: int) -> DataFrame:
    """(shard, payload): distinct keys and summed counts of each shard, merged FAN rows at a time; written."""

    def run(table):
        parts = [unpack(p.as_py()) for p in table.column("payload")]
        k, c = sum_by_key([p[0] for p in parts], [p[1] for p in parts])
        return pa.table({"shard": table.column("shard")[:1], "part": table.column("part")[:1],
                         "payload": pa.array([pack(k, c)], pa.binary())})

    parts = math.ceil(n_chunks / FAN)
    now = rows.where(F.col("shard") != DOCS).select("shard", F.pmod(F.xxhash64("chunk"), F.lit(max(parts, 1))).cast("int").alias("part"), "payload")
    while True:
        now = now.groupBy("shard", "part").applyInArrow(run, "shard int, part int, payload binary")
        if parts <= 1:
            return now.select("shard", "payload").checkpoint()
        parts = math.ceil(parts / FAN)
        now = now.withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))


def copies(asked: int, model: int) -> int:
    """Copies of a shard's model: one, and more only while their bytes together are at most those of the shard's requests."""
    return max(1, asked // max(model, ANSWER_BYTES, 1))


def answer(rows: DataFrame, model: DataFrame, asked_bytes: dict[int, int]) -> DataFrame:
    """ROWS: the values of every request, in the request's order; ``model``: (shard, payload of keys and values).

    A shard's requests are salted by their own bytes (``asked_bytes``): a task holds one model and at
    most about twice max(model, ANSWER_BYTES) of requests, and copied models never exceed the requests they answer.
    """
    sizes = model.select("shard", F.octet_length("payload").alias("n")).collect()  # one row per shard
    made = [(x.shard, copies(asked_bytes.get(x.shard, 0), x.n)) for x in sizes]
    salts = F.broadcast(model.sparkSession.createDataFrame(made, "shard int, salts int"))
    asked = rows.where(F.col("shard") != DOCS).drop("salt").join(salts, "shard").select(
        "chunk", "shard", F.pmod(F.xxhash64("chunk"), F.col("salts")).cast("int").alias("salt"), "payload")
    spread = model.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def run(left, right):
        if not left.num_rows:
            return left.select(["chunk", "shard", "salt", "payload"])
        keys, values = unpack(right.column("payload")[0].as_py())
        out = []
        for p in left.column("payload"):
            own = unpack(p.as_py())[0]
            out.append(pack(values[np.searchsorted(keys, own)]))
        return pa.table({"chunk": left.column("chunk"), "shard": left.column("shard"), "salt": left.column("salt"),
                         "payload": pa.array(out, pa.binary())})

    return asked.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(run, ROWS)


class Lookup:
    """Open-addressing table of sorted distinct keys to values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, math.ceil(math.log2(max(len(keys), 1) * 3)))
        self.mask = np.int64((1 << self.bits) - 1)
        self.key = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.value = np.zeros(1 << self.bits, values.dtype)
        left, at = np.arange(len(keys)), self._slot(keys)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        while len(left):
            free = self.key[at] == empty
            self.key[at[free]] = keys[left[free]]
            mine = self.key[at] == keys[left]
            self.value[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.value[at]
        left = np.flatnonzero(self.key[at] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            hit = self.key[at] == keys[left]
            out[left[hit]] = self.value[at[hit]]
            left, at = left[~hit], at[~hit]
        return out


def scored(rows: DataFrame, answers: DataFrame, text: str, train: str, depth: int, shards: int, lower: bool,
           with_words: bool, score, schema: str) -> DataFrame:
    """Per chunk ``score(table of documents, text column, grams Lookup, words Lookup or None)`` -> record batch."""

    def run(table):
        where = {s: p for s, p in zip(table.column("shard").to_pylist(), table.column("payload"))}
        docs = pa.ipc.open_stream(where.pop(DOCS).as_py()).read_all().combine_chunks()
        column = docs.column(text).combine_chunks()
        # the chunk's keys again, in the order in which they were sent
        found = distinct_keys(column, np.zeros(docs.num_rows, bool), depth, shards, lower, with_words)
        if with_words:
            s = int(word_shard(np.array([END_TOKEN]), shards)[0])
            k, c = found.get(s, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            found[s] = (np.insert(k, 0, END_TOKEN), np.insert(c, 0, 0))
        tables = []
        for low, high in ((0, shards), (shards, 2 * shards)):
            mine = [s for s in found if low <= s < high]
            keys = np.concatenate([found[s][0] for s in mine]) if mine else np.zeros(0, np.uint64)
            values = [unpack(where[s].as_py())[0] for s in mine]
            tables.append(Lookup(keys, np.concatenate(values) if mine else np.zeros(0, np.float32)))
        del where, found, table
        out = pa.Table.from_batches([score(docs, column, *tables)])
        del docs, column, tables
        pa.default_memory_pool().release_unused()
        return out

    return rows.where(F.col("shard") == DOCS).unionByName(answers).groupBy("chunk").applyInArrow(run, schema)


def prepare(docs: DataFrame, text: str, train: str, depth: int, lower: bool, with_words: bool, chunk_bytes: int = CHUNK_BYTES):
    """(rows, bytes of requests per shard, number of shards, merged counts)."""
    checkpoint_dir(docs.sparkSession)
    shards = shard_count(docs, text)
    rows = chunks(docs, text, train, depth, shards, lower, with_words, chunk_bytes)
    # one row per shard
    found = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("payload").cast("long")).alias("n")).collect()
    n_chunks = sum(x.k for x in found if x.shard == DOCS)
    return rows, {x.shard: x.n for x in found if x.shard != DOCS}, shards, merge(rows, n_chunks)
