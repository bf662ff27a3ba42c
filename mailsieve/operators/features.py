"""TF-IDF features as long tables.

Layout: ``(doc_id, ns, term, value)`` with ``ns`` in {word, char}; a
``VectorUDT`` is only built at the pyspark.ml boundary (``to_vectors``).

Plan shape for scale
* Term counts of a document are made where its text is read (an Arrow task
  counts the n-grams of some texts at once, as sorted integer codes), so neither the text nor n-gram
  occurrences are shuffled or persisted; rows are one per distinct term of a document.
* Only in-vocabulary rows are shuffled, once, by key: the norm and everything that is
  gathered per document afterwards use that partitioning.
* Corpus statistics (df, collection frequency) aggregate map-side before the
  exchange: a shuffle of distinct terms per task, not of term occurrences.
* The vocabulary is capped at ``max_features`` per namespace (a bounded
  top-N, TakeOrdered), which is the proven bound that makes its broadcast safe.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.constants import (
    CHAR_NGRAM_RANGE,
    ENGLISH_STOP_WORDS,
    MAX_FEATURES_CHAR,
    MAX_FEATURES_WORD,
    WORD_NGRAM_RANGE,
)
from mailsieve.functions.text import WORD_TOKEN, char_prepare
from mailsieve.session import checkpoint_dir


#: code points (or tokens) of the texts that are counted at once; a longer text is counted alone
SLICE = 1 << 20
#: bytes of the texts that a task counts or weighs, as n-grams take far more time and room than their text
TASK_BYTES = 4 << 20


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows with about SLICE units in all."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, "right")) - 1)
        yield at, end
        at = end


def _counted_ngrams(units: np.ndarray, row: np.ndarray, n_units: int, limits: tuple[int, int]):
    """Per order n of the limits: (row, grams, which, tf) of the n-grams of every row, from the units of all rows side by side.

    ``grams`` has one row of n units per distinct n-gram, ``which`` numbers them.  Row and units are packed into one 64-bit
    code, which a plain sort counts; where they need more bits, the first n-1 units are replaced by their number among the distinct ones.
    """
    width = max(int(n_units - 1).bit_length(), 1)
    for n in range(limits[0], limits[1] + 1):
        if len(units) < n:
            break
        inside = row[:len(units) - n + 1] == row[n - 1:]
        start = np.flatnonzero(inside)
        if not len(start):
            continue
        rows = row[start]
        if n * width + int(row[-1]).bit_length() < 63:
            code = rows
            for k in range(n):
                code = code << width | units[start + k]
            code, tf = _sorted_counts(np.sort(code))
            gram = code & ((1 << n * width) - 1)
            distinct, which = np.unique(gram, return_inverse=True)
            grams = np.stack([distinct >> width * (n - 1 - k) & ((1 << width) - 1) for k in range(n)], 1)
            yield code >> n * width, grams, which, tf
            continue
        number = units[start]
        for k in range(1, n):
            _, place, number = np.unique(number * n_units + units[start + k], return_index=True, return_inverse=True)
        distinct, place, number = np.unique(number, return_index=True, return_inverse=True)
        key, tf = np.unique(rows * len(distinct) + number, return_counts=True)
        yield key // len(distinct), units[start[place][:, None] + np.arange(n)], key % len(distinct), tf


def _sorted_counts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and their counts."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _strings(points: np.ndarray) -> pa.Array:
    """One string per row of code points."""
    text = np.ascontiguousarray(points, np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    sizes = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).sum(1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(text))


def _word_grams(texts: list, limits, token, stop):
    """(row, distinct terms, which, tf) of the word n-grams of some texts, order by order."""
    found = [token.findall(x or "") for x in texts]
    flat = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
    units, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    kept = np.array([t not in stop for t in names.to_pylist()], bool)[units]
    row = np.repeat(np.arange(len(found)), [len(t) for t in found])
    for at, grams, which, tf in _counted_ngrams(units[kept], row[kept], max(len(names), 1), limits):
        terms = names.take(pa.array(grams[:, 0]))
        for k in range(1, grams.shape[1]):
            terms = pc.binary_join_element_wise(terms, names.take(pa.array(grams[:, k])), " ")
        yield at, terms, which, tf


def _char_grams(texts: list, limits):
    """(row, distinct terms, which, tf) of the character n-grams of some texts, order by order."""
    row = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    # numbers by a table of all code points up to the greatest
    there = np.zeros(int(points.max()) + 1 if len(points) else 1, bool)
    there[points] = True
    alphabet = np.flatnonzero(there)
    numbers = np.cumsum(there) - 1
    for at, grams, which, tf in _counted_ngrams(numbers[points], row, max(len(alphabet), 1), limits):
        yield at, _strings(alphabet[grams]), which, tf


def _grams_of(words, chars, word_range, char_range, token, stop):
    """(ns, first row of the slice, row in it, distinct terms, which, tf) of neighbouring rows, slice by slice."""
    for ns, values, limits in (("word", words, word_range), ("char", chars, char_range)):
        if limits is None:
            continue
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, end in slices(sizes):
            texts = values.slice(first, end - first).to_pylist()
            for found in _word_grams(texts, limits, token, stop) if ns == "word" else _char_grams(texts, limits):
                yield ns, first, *found


def _tokens(stop_words):
    import regex

    return regex.compile(WORD_TOKEN), frozenset(stop_words or ())


def _count_terms(word_range, char_range, stop_words):
    """Arrow task: (key, words text, chars text) -> (key, ns, term, tf), counted on arrays of many texts at once."""
    def run(batches):
        token, stop = _tokens(stop_words)
        for batch in batches:
            for ns, first, at, terms, which, tf in _grams_of(batch.column(1), batch.column(2), word_range, char_range, token, stop):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + first)), pa.repeat(pa.scalar(ns), len(at)),
                                                  terms.take(pa.array(which)), pa.array(tf.astype(np.int64))], ["key", "ns", "term", "tf"])

    return run


def _count_stats(word_range, char_range, stop_words):
    """Arrow task: (key, words text, chars text) -> (ns, term, df, cf) of some neighbouring texts at once; a text without a key has no df."""
    def run(batches):
        token, stop = _tokens(stop_words)
        for batch in batches:
            keyed = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            for ns, first, at, terms, which, tf in _grams_of(batch.column(1), batch.column(2), word_range, char_range, token, stop):
                df = np.bincount(which[keyed[at + first]], minlength=len(terms))
                cf = np.bincount(which, tf, minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(ns), len(terms)), terms, pa.array(df.astype(np.int64)), pa.array(cf)],
                                                 ["ns", "term", "df", "cf"])

    return run


def size_of(docs: DataFrame, text: str = "body_text") -> tuple[int, int]:
    """(rows, tasks): the number of texts, and of tasks of about TASK_BYTES each, so a task does not grow with the table."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size")).first()
    return r["n"], max(docs.sparkSession.sparkContext.defaultParallelism, -(-r["size"] // TASK_BYTES))


def _prepared(docs: DataFrame, key: str, text: str, word_range, char_range) -> DataFrame:
    words = F.lower(F.coalesce(F.col(text), F.lit(""))) if word_range else F.lit("")
    chars = char_prepare(text) if char_range else F.lit("")
    return docs.select(F.col(key).alias("key"), words.alias("w"), chars.alias("c"))


def _terms(docs: DataFrame, key: str, text: str, word_range, char_range, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    counted = _prepared(docs, key, text, word_range, char_range).mapInArrow(
        _count_terms(word_range, char_range, stop_words), f"key {kind}, ns string, term string, tf long")
    return counted.withColumnRenamed("key", key)


def word_terms(docs: DataFrame, key: str = "doc_id", text: str = "body_text",
               ngram_range=WORD_NGRAM_RANGE, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """(key, ns='word', term, tf) counts of word 1..n-grams of every row (null text: none)."""
    return _terms(docs, key, text, ngram_range, None, stop_words)


def char_terms(docs: DataFrame, key: str = "doc_id", text: str = "body_text", ngram_range=CHAR_NGRAM_RANGE) -> DataFrame:
    """(key, ns='char', term, tf) counts of character n-grams (whitespace runs collapsed)."""
    return _terms(docs, key, text, None, ngram_range)


def terms(docs: DataFrame, key: str = "doc_id", text: str = "body_text", use_char: bool = False,
          char_range=CHAR_NGRAM_RANGE) -> DataFrame:
    """Word (and optionally char) term counts, stacked as (key, ns, term, tf), from one pass over the text."""
    return _terms(docs, key, text, WORD_NGRAM_RANGE, char_range if use_char else None)


def term_stats(term_counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per (ns, term) document frequency and collection frequency."""
    return term_counts.groupBy("ns", "term").agg(F.count(key).alias("df"), F.sum("tf").alias("cf"))


def _text_stats(docs: DataFrame, key: str, text: str, word_range, char_range) -> DataFrame:
    parts = _prepared(docs, key, text, word_range, char_range).mapInArrow(
        _count_stats(word_range, char_range, ENGLISH_STOP_WORDS), "ns string, term string, df long, cf long")
    return parts.groupBy("ns", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def text_stats(docs: DataFrame, key: str = "doc_id", text: str = "body_text", use_char: bool = False) -> DataFrame:
    """D20 as ``term_stats(terms(...))``, but a task adds up neighbouring texts before rows leave it."""
    return _text_stats(docs, key, text, WORD_NGRAM_RANGE, CHAR_NGRAM_RANGE if use_char else None)


def fit_vocabulary(term_counts: DataFrame, n_docs, key: str = "doc_id",
                   max_features: dict | None = None) -> DataFrame:
    """F5 + H22 idf: top ``max_features[ns]`` terms by collection frequency (ties: term
    ascending), with smooth idf = ln((1 + n) / (1 + df)) + 1."""
    return cap_vocabulary(term_stats(term_counts, key), n_docs, max_features)


def cap_vocabulary(st: DataFrame | dict[str, DataFrame], n_docs, max_features: dict | None = None) -> DataFrame:
    """``fit_vocabulary`` from the corpus statistics, of all namespaces or by namespace (each is counted for its own cap only)."""
    caps = max_features or {"word": MAX_FEATURES_WORD, "char": MAX_FEATURES_CHAR}
    parts = []
    for ns, cap in caps.items():
        of_ns = st[ns] if isinstance(st, dict) else st.where(F.col("ns") == ns)
        parts.append(of_ns.orderBy(F.desc("cf"), F.asc("term")).limit(int(cap)))
    v = parts[0]
    for p in parts[1:]:
        v = v.unionByName(p)
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return v.select("ns", "term", "df", "cf", idf.alias("idf"))


def transform(term_counts: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sub-linear tf x idf, L2-normalised per document and namespace.

    Terms outside the vocabulary drop in the (broadcast, bounded) join.  The norms
    are windows over the document, so one shuffle by key serves them and what follows per document.
    """
    j = term_counts.join(F.broadcast(vocab.select("ns", "term", "idf")), ["ns", "term"])
    w = (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf")
    x = j.select(key, "ns", "term", w.alias("__w"))
    by_doc = Window.partitionBy(key)
    square = F.col("__w") * F.col("__w")
    word = F.sum(F.when(F.col("ns") == "word", square)).over(by_doc)
    char = F.sum(F.when(F.col("ns") == "char", square)).over(by_doc)
    return x.select(key, "ns", "term", (F.col("__w") / F.sqrt(F.when(F.col("ns") == "word", word).otherwise(char))).alias("value"))


def _weigh_texts(vocabulary, word_range, char_range, stop_words):
    """Arrow task: (key, its words texts, its chars texts) -> (key, ns, term, value) of the vocabulary's terms, L2-normalised per key and namespace.

    ``vocabulary``: broadcast {ns: (terms, idf)}.
    """
    def run(batches):
        token, stop = _tokens(stop_words)
        known = {ns: (pa.array(terms, pa.string()), np.array(idf, float)) for ns, (terms, idf) in vocabulary.value.items()}
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            sizes = [pc.fill_null(pc.binary_length(batch.column(c).flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2)]
            total, ends = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])]), np.cumsum(lengths)
            # keys with about SLICE bytes in all
            for first, end in slices(total[ends] - total[ends - lengths]):
                keys, words, chars = batch.slice(first, end - first).columns
                yield from _weighed(keys, words, chars, known, word_range, char_range, token, stop)

    return run


def _weighed(keys: pa.Array, words: pa.Array, chars: pa.Array, known: dict, word_range, char_range, token, stop):
    of_text = np.repeat(np.arange(len(keys)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    found: dict = {ns: [] for ns in known}
    for ns, first, at, terms, which, tf in _grams_of(words.flatten(), chars.flatten(), word_range, char_range, token, stop):
        if ns in known:
            number = pc.fill_null(pc.index_in(terms, value_set=known[ns][0]), -1).to_numpy(zero_copy_only=False)[which]
            kept = number >= 0
            number = number[kept]
            found[ns].append((of_text[at[kept] + first], number, (1.0 + np.log(tf[kept])) * known[ns][1][number]))
    for ns, parts in found.items():
        if parts:
            of_key, number, w = (np.concatenate(x) for x in zip(*parts))
            value = w / np.sqrt(np.bincount(of_key, w * w, minlength=len(keys)))[of_key]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of_key)), pa.repeat(pa.scalar(ns), len(of_key)), known[ns][0].take(pa.array(number)),
                                              pa.array(value)], ["key", "ns", "term", "value"])


def transform_texts(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "body_text", use_char: bool = False,
                    tasks: int | None = None) -> DataFrame:
    """H22/M8 as ``transform(terms(...))``, from one shuffle of the texts by key, into ``tasks`` (see ``size_of``) if given.

    The texts of a key meet in one row, so its norm needs no other one, and only rows of the vocabulary, which is bounded by its
    caps and sent to the tasks, leave a task.
    """
    word_range, char_range = WORD_NGRAM_RANGE, CHAR_NGRAM_RANGE if use_char else None
    listed: dict = {}
    for r in vocab.select("ns", "term", "idf").collect():
        terms, idf = listed.setdefault(r["ns"], ([], []))
        terms.append(r["term"])
        idf.append(r["idf"])
    sent = docs.sparkSession.sparkContext.broadcast(listed)
    kind = docs.schema[key].dataType.simpleString()
    prepared = _prepared(docs.repartition(tasks, key) if tasks else docs, key, text, word_range, char_range)
    per = prepared.groupBy("key").agg(F.collect_list("w").alias("w"), F.collect_list("c").alias("c"))
    weighed = per.mapInArrow(_weigh_texts(sent, word_range, char_range, ENGLISH_STOP_WORDS), f"key {kind}, ns string, term string, value double")
    return weighed.withColumnRenamed("key", key)


def fit_transform(train_docs: DataFrame, other_docs: DataFrame | None = None, key: str = "doc_id",
                  text: str = "body_text", use_char: bool = False, max_features: dict | None = None):
    """M8: fit on ``train_docs``, transform both.  Returns (vocab, train_features, other_features).

    The vocabulary (bounded by the caps) is written once; the texts are counted again for the
    transform, which is cheaper than keeping about three rows per character.
    """
    checkpoint_dir(train_docs.sparkSession)
    caps = max_features or ({"word": MAX_FEATURES_WORD, "char": MAX_FEATURES_CHAR} if use_char else {"word": MAX_FEATURES_WORD})
    n, tasks = size_of(train_docs, text)
    # copies of a text and rows without a key are spread, too
    spread = train_docs.select(key, text).repartition(tasks, key, text)
    stats = {"word": _text_stats(spread, key, text, WORD_NGRAM_RANGE, None)}
    if use_char:
        stats["char"] = _text_stats(spread, key, text, None, CHAR_NGRAM_RANGE)
    vocab = cap_vocabulary({ns: stats[ns] for ns in caps}, n, {ns: caps[ns] for ns in caps}).checkpoint()
    tr = transform_texts(train_docs, vocab, key, text, use_char, tasks)
    ot = transform_texts(other_docs, vocab, key, text, use_char, size_of(other_docs, text)[1]) if other_docs is not None else None
    return vocab, tr, ot


def feature_index(vocab: DataFrame) -> DataFrame:
    """Dense column index per vocabulary term (word terms first, then char), for vectors.

    The vocabulary is bounded by the caps, so a single ordered window over it is fine.
    """
    w = Window.orderBy(F.when(F.col("ns") == "word", 0).otherwise(1), "term")
    return vocab.select("ns", "term", (F.row_number().over(w) - 1).alias("idx"))


def to_vectors(features: DataFrame, index: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """Long table -> (key, SparseVector) for pyspark.ml.

    Per-document entries are bounded by the vocabulary.  Spark SQL cannot
    produce a VectorUDT value, so this ML boundary uses a small Python UDF
    (one call per document, linear in its non-zeros).
    """
    from pyspark.ml.linalg import Vectors, VectorUDT

    j = features.join(F.broadcast(index), ["ns", "term"])
    per = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("__e"))

    @F.udf(VectorUDT())
    def _vec(entries):
        return Vectors.sparse(size, [int(e[0]) for e in entries], [float(e[1]) for e in entries])

    return per.select(key, _vec("__e").alias("features"))
