"""Operator 10: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (derived from its code point, so
all executors agree without sending any table).  An n-gram of letters is bound
as the product of its letters' vectors, each rotated by its place; a text is the
bundle (sum) of its n-gram vectors.  A language prototype bundles the
unit-length vectors of its training texts; a text gets the language of the
prototype with the highest cosine.

Texts are lower-cased; runs of anything but letters are one space, so n-grams
see word ends.  Vectors are built per slice as (documents x distinct n-grams)
counts times n-gram vectors, in chunks of n-grams, so memory does not depend on
the text or the alphabet.  Training sends one partial sum per task and language;
these are added by (language, dimension).  The prototypes (languages x DIM) are
broadcast after a check of their size.

Null text or a text without a letter: ``und``, score 0.  Without training texts
every document is ``und``.  Ties: the smaller language name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.llm.textbytes import mix, slices
from mailsieve.session import checkpoint_dir

DIM = 512
NGRAM = 3
CHUNK = 2048
UNKNOWN = "und"
#: prototypes are broadcast: at most this many languages
MAX_LANGUAGES = 20_000
PREDICTED = "__language"

_classes: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """By code point: the letter itself, or a space for anything that is no letter."""
    if "table" not in _classes:
        n = 0x110000
        table = np.full(n, 32, np.uint32)
        table[[c for c in range(n) if chr(c).isalpha()]] = 1
        _classes["table"] = np.where(table == 1, np.arange(n, dtype=np.uint32), table)
    return _classes["table"]


def letter_vectors(points: np.ndarray, dim: int) -> np.ndarray:
    """(points x dim) int8 of +1 and -1, a function of the code points alone."""
    seed = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(seed)).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _letter_ids(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a slice (newline after each document) -> the letters and spaces kept, as indexes into the
    distinct code points, and their places.  Index 0 is the newline."""
    breaks = text == 10
    folded = np.where(breaks, 10, _letters()[text])
    keep = (folded != 32) | np.append(True, folded[:-1] != 32)
    place = np.flatnonzero(keep)
    kept = folded[place]
    points = np.flatnonzero(np.bincount(kept))  # 10 is the smallest
    index = np.zeros(int(points[-1]) + 1, np.int64)
    index[points] = np.arange(len(points))
    return index[kept], place, points


def _gram_counts(text: np.ndarray, ends: np.ndarray, ngram: int):
    """(document, n-gram code, count) of a slice, the distinct codes and the code points that they index."""
    ids, place, points = _letter_ids(text)
    base = len(points)
    space = int(np.searchsorted(points, 32))
    n = max(len(ids) - ngram + 1, 0)
    code = np.zeros(n, np.int64)
    usable, letter = np.ones(n, bool), np.zeros(n, bool)
    for k in range(ngram):
        part = ids[k:k + n]
        code = code * base + part
        usable &= part != 0
        letter |= part != space
    usable &= letter
    owner = np.searchsorted(ends, place[np.flatnonzero(usable) + ngram - 1], "right")
    key = owner * base**ngram + code[usable]
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    owner, code = np.divmod(key[first], base**ngram)
    if base**ngram <= 1 << 21:
        here = np.zeros(base**ngram, bool)
        here[code] = True
        distinct = np.flatnonzero(here)
        which = (np.cumsum(here) - 1)[code]
    else:
        distinct, which = np.unique(code, return_inverse=True)
    return owner, which, count, distinct, points


def bundles(texts: pa.Array, dim: int = DIM, ngram: int = NGRAM):
    """Per slice: index of its first document, (documents x dim) float32 bundle vectors, has-letter flags."""
    for piece in slices(texts, lower=False):
        blob = piece.data.tobytes().decode().lower().replace("\r", " ")
        parts = blob.split("\n")
        n = len(piece.starts)
        if len(parts) != n + 1:  # texts with newlines of their own
            parts = [piece.data[a:b].tobytes().decode().lower().replace("\n", " ") for a, b in zip(piece.starts, piece.ends)] + [""]
        parts = [f" {p} " for p in parts[:n]]
        size = np.array([len(p) + 1 for p in parts])
        points = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le"), np.uint32)
        ends = np.cumsum(size)
        owner, which, count, distinct, letters = _gram_counts(points, ends, ngram)
        base = len(letters)
        has = np.zeros(n, bool)
        has[owner] = True
        out = np.zeros((n, dim), np.float32)
        vector = letter_vectors(letters, dim)
        for lo in range(0, len(distinct), CHUNK):
            grams = distinct[lo:lo + CHUNK]
            mine = (which >= lo) & (which < lo + CHUNK)
            counts = np.zeros((n, len(grams)), np.float32)
            counts[owner[mine], which[mine] - lo] = count[mine]
            bound = np.ones((len(grams), dim), np.int8)
            for k in range(ngram):
                digit = grams // base ** (ngram - 1 - k) % base
                bound *= np.roll(vector, ngram - 1 - k, axis=1)[digit]
            out += counts @ bound.astype(np.float32)
        yield piece.first, out, has


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def prototypes(training: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, ngram: int = NGRAM) -> DataFrame:
    """(lang, dim index, value): the bundled unit vectors of the training texts of each language."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, vectors, _ in bundles(batch.column(0), dim, ngram):
                unit = _unit(vectors)
                own = np.array(names[first:first + len(unit)], object)
                for name in set(own):
                    total[name] = total.get(name, 0) + unit[own == name].sum(0, dtype=np.float64)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x] for x in names],
                                                                                 pa.list_(pa.float64()))], ["lang", "vector"])

    use = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    partial = use.mapInArrow(run, "lang string, vector array<double>")
    each = partial.select("lang", F.posexplode("vector").alias("k", "x"))
    return each.groupBy("lang", "k").agg(F.sum("x").alias("x"))


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", dim: int = DIM, ngram: int = NGRAM) -> DataFrame:
    """``docs`` and struct ``__language`` (lang, score): the nearest prototype and its cosine, cut to 0..1."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    profiles = profiles.checkpoint()  # languages x dimensions; read twice below
    names = [r[0] for r in profiles.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()
    index = {x: i for i, x in enumerate(names)}
    matrix = np.zeros((len(names), dim))
    for name, k, x in profiles.select("lang", "k", "x").toLocalIterator():
        matrix[index[name], k] = x
    model = spark.sparkContext.broadcast((names, _unit(matrix).astype(np.float32)))
    field = T.StructType([T.StructField("lang", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    arrow = pa.struct([pa.field("lang", pa.string(), False), pa.field("score", pa.float64(), False)])

    def run(batches):
        names, matrix = model.value
        for batch in batches:
            out: list[dict] = []
            for _, vectors, has in bundles(batch.column(batch.schema.get_field_index(text)), dim, ngram):
                if not names:
                    out += [{"lang": UNKNOWN, "score": 0.0}] * len(has)
                    continue
                cosine = _unit(vectors) @ matrix.T
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(np.float64)
                out += [{"lang": names[b], "score": s} if h else {"lang": UNKNOWN, "score": 0.0}
                        for b, s, h in zip(best.tolist(), score.tolist(), has.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, PREDICTED])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(PREDICTED, field, False)]))


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """True for documents that are kept from training: crc32(key as text) mod folds is ``fold``; a null key is the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == fold


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    return predict(docs, prototypes(docs.where(~held_out(key)).select(text, lang), text, lang), text)


def keep_identified(docs: DataFrame, min_score: float = 0.05, **kw) -> DataFrame:
    """``docs`` without the documents that have no language or are close to none."""
    found = identify(docs, **kw)
    return found.where((F.col(f"{PREDICTED}.lang") != UNKNOWN) & (F.col(f"{PREDICTED}.score") >= min_score)).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out().alias("held_out"), F.col(f"{PREDICTED}.lang").alias("lang_pred"),
                        F.col(f"{PREDICTED}.score").alias("score"))
