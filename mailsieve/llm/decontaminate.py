"""Operator 1: benchmark decontamination.

The windows of ``n`` consecutive words of every benchmark item are hashed into
a set that is broadcast; one pass over the documents hashes every window of
every text, looks it up in the set and compares each hit word by word before it
counts.  Nothing is shuffled.

* Words: A-Z lower-cased, runs of digits, letters and non-ASCII characters.
  An item of fewer than ``n`` words (but not none) is one window.
* Broadcast bound: the benchmark is read in blocks of at most ``block_bytes``
  of text (whole items); one block is one pass, its set is built from that
  block alone.  With more than one block the documents keep the hits of the
  earlier passes in a column, so the result is the same as in one pass.
* Null or empty texts have no words and no hits.  Null items have no windows; a
  null item id marks hits but is not listed.  Repeated documents are judged
  each for itself.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.llm.textbytes import ALNUM_WORD, slices, span_hash, words
from mailsieve.session import checkpoint_dir

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: name of the struct column that ``contamination`` adds
FOUND = "__contamination"
FOUND_TYPE = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.LongType(), False), T.StructField("n_words", T.LongType(), False),
        T.StructField("start_byte", T.LongType(), False), T.StructField("end_byte", T.LongType(), False)])), False),
    T.StructField("items", T.ArrayType(T.StringType()), False)])
_ARROW_FOUND = pa.struct([
    pa.field("n_words", pa.int64(), False),
    pa.field("spans", pa.list_(pa.struct([pa.field(x, pa.int64(), False)
                                          for x in ("first_word", "n_words", "start_byte", "end_byte")])), False),
    pa.field("items", pa.list_(pa.string()), False)])
_FLAGS = 20


class WindowSet:
    """The windows of a block of benchmark items, by number of words, then by hash."""

    def __init__(self, items: list[tuple], n: int) -> None:
        exact: dict[tuple[bytes, ...], set] = {}
        for item_id, text in items:
            (piece,) = slices(pa.array([text], pa.string()))
            w = words(piece, ALNUM_WORD)
            own = [piece.data[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
            for i in range(max(1, len(own) - n + 1) if own else 0):
                exact.setdefault(tuple(own[i:i + n]), set()).add(item_id)
        self.by_length = {}
        for k in {len(x) for x in exact}:
            mine = [x for x in exact if len(x) == k]
            keys = self._hashes(mine)
            order = np.argsort(keys)
            flags = np.zeros(1 << _FLAGS, bool)
            flags[keys >> np.uint64(64 - _FLAGS)] = True
            self.by_length[k] = (keys[order], flags,
                                 [(b"".join(mine[j]), tuple(map(len, mine[j])), exact[mine[j]]) for j in order])

    @staticmethod
    def _hashes(windows: list[tuple[bytes, ...]]) -> np.ndarray:
        out = []
        for w in windows:
            data = np.frombuffer(b" ".join(w), np.uint8)
            ends = np.cumsum([len(x) + 1 for x in w]) - 1
            h = span_hash(data, ends - [len(x) for x in w], ends)
            out.append(span_hash(h, np.array([0]), np.array([len(h)]), 1)[0])
        return np.array(out, np.uint64)

    def hits(self, piece, w) -> list[tuple[int, int, set]]:
        """(first word, number of words, item ids) of every occurrence in a slice."""
        found, n = [], len(w.starts)
        hashed = span_hash(piece.data, w.starts, w.ends)
        size = w.ends - w.starts
        inside = np.concatenate([[0], np.cumsum(size)])
        letters = None
        doc_end = np.repeat(w.first[1:], np.diff(w.first))
        for k, (keys, flags, refs) in self.by_length.items():
            at = np.flatnonzero(np.arange(n) + k <= doc_end)
            if not len(at):
                continue
            h = span_hash(hashed, at, at + k, 1)
            some = flags[h >> np.uint64(64 - _FLAGS)]
            at, h = at[some], h[some]
            low = np.searchsorted(keys, h)
            same = keys[np.minimum(low, len(keys) - 1)] == h
            for i, j, key in zip(at[same].tolist(), low[same].tolist(), h[same]):
                if letters is None:
                    letters = piece.data[np.repeat(w.starts - inside[:-1], size) + np.arange(inside[-1])]
                text, lengths = letters[inside[i]:inside[i + k]].tobytes(), tuple(size[i:i + k].tolist())
                while j < len(keys) and keys[j] == key:  # verified word by word
                    if refs[j][0] == text and refs[j][1] == lengths:
                        found.append((i, k, refs[j][2]))
                    j += 1
        return found


def _merge(n_words: int, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(hits):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _scan(windows, text: str, again: bool):
    def run(batches):
        for batch in batches:
            result = []
            earlier = batch.column(FOUND).to_pylist() if again else None
            for piece in slices(batch.column(batch.schema.get_field_index(text))):
                w = words(piece, ALNUM_WORD)
                n_docs = len(piece.starts)
                ranges: dict[int, list] = {}
                items: dict[int, set] = {}
                hits = windows.value.hits(piece, w)
                owners = np.searchsorted(w.first, [x[0] for x in hits], "right") - 1 if hits else ()
                for (i, k, ids), d in zip(hits, owners):
                    ranges.setdefault(int(d), []).append((i, i + k))
                    items.setdefault(int(d), set()).update(str(x) for x in ids if x is not None)
                for d in range(n_docs):
                    lo = int(w.first[d])
                    n = int(w.first[d + 1]) - lo
                    spans, ids = ranges.get(d, []), items.get(d, set())
                    if earlier and (old := earlier[piece.first + d]):
                        spans = spans + [(lo + s["first_word"], lo + s["first_word"] + s["n_words"]) for s in old["spans"]]
                        ids = ids | set(old["items"])
                    out = [{"first_word": a - lo, "n_words": b - a, "start_byte": int(w.starts[a] - piece.starts[d]),
                            "end_byte": int(w.ends[b - 1] - piece.starts[d])} for a, b in _merge(n, spans)]
                    result.append({"n_words": n, "spans": out, "items": sorted(ids)})
            found = pa.array(result, _ARROW_FOUND)
            keep = [(f.name, c) for f, c in zip(batch.schema, batch.columns) if f.name != FOUND]
            yield pa.RecordBatch.from_arrays([c for _, c in keep] + [found], [x for x, _ in keep] + [FOUND])

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Lists of items of at most ``block_bytes`` of text each (a longer item alone)."""
    block, size = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item), F.col(text)).toLocalIterator()
    for item_id, body in rows:
        n = len(body.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, body))
        size += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and a struct column ``__contamination``: n_words, merged hit spans (words and UTF-8 bytes), item ids."""
    spark = docs.sparkSession
    for k, block in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        if k:
            checkpoint_dir(spark)
            docs = docs.checkpoint()
        windows = spark.sparkContext.broadcast(WindowSet(block, n))
        plain = [f for f in docs.schema.fields if f.name != FOUND]
        schema = T.StructType([*plain, T.StructField(FOUND, FOUND_TYPE, True)])
        docs = docs.mapInArrow(_scan(windows, text, k > 0), schema)
    return docs


def hit_words(found=FOUND):
    """Number of words inside any hit."""
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda a, s: a + s["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 0.5, **kw) -> DataFrame:
    """Remove hit spans from the texts; drop documents of which at least ``drop_share`` of the words are hit.

    Same columns as ``docs``.  A document without a hit is returned unchanged.
    """
    found = contamination(docs, benchmark, text, **kw)
    body = F.col(text).cast("binary")
    size = F.octet_length(body)
    spans = F.col(f"{FOUND}.spans")
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substring(
        body,
        F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end_byte"]).cast("int") + 1,
        (F.when(i == F.size(spans), size.cast("long")).otherwise(F.get(spans, i)["start_byte"])
         - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1)["end_byte"])).cast("int")).cast("string"))
    kept = found.where((F.size(spans) == 0) | (hit_words() < F.lit(drop_share) * F.col(f"{FOUND}.n_words")))
    clean = F.when(F.size(spans) == 0, F.col(text)).otherwise(F.concat_ws("", pieces))
    return kept.withColumn(text, clean).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The report per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    items = F.col(f"{FOUND}.items")
    return found.select(
        "doc_id", F.col(f"{FOUND}.n_words").alias("n_words"), hit_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"))

