"""Operator 11: source divergence audit, with duplicate-text collapse.

Identical texts of a language are grouped (by 128 bits of SHA-256) with how often every
source has them, and each is tokenized once; its counts enter every source's
weighted by that multiplicity.  Terms are runs of ASCII letters and of anything beyond ASCII, A-Z
lower-cased.  A language keeps the V terms in at least ``min_docs`` of its documents.  Every
group (language, source) and every language has, for a kept term with count occurrences,

    p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)),   N: all its occurrences of kept terms.

``pairs`` sums |p - q| over all kept terms for every two sources of a language, ``terms``
lists the terms that a source has more of than its language.

Sparse evaluation: a term that neither source has adds |z - z'| with z the value of count 0, so

    sum = V |z - z'| + one(a, b) + one(b, a) + both(a, b)

where ``one`` corrects for the terms that a source has (from its distinct values with their
frequency) and ``both`` for those that two sources have (from the term's own list of
sources).  Nothing is done for sources without the term.  All arithmetic is on integers.

Scale: the texts are shuffled once, copies are combined before.  Tasks emit counts per (language, source, term) of
about ROWS rows at a time, Spark adds them up; of the terms below ``min_docs`` nothing is kept.  A term's list
has at most one entry per source; a task adds up ``both`` per pair of sources, so rows of pairs
are made per task, not per term.

Null text, language and source are empty strings.  Texts without terms count
as documents of their group; repeated rows are documents each.  A language without kept terms has value 0
for all pairs.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.llm.textbytes import byte_class, slices, words
from mailsieve.session import checkpoint_dir

MIN_DOCS = 30
TOP = 50
SCALE, SMOOTH = 1_000_000_000, 5
#: rows that a task holds before it combines or emits them
ROWS = 1 << 19
LETTERS = byte_class((0x61, 0x7A), (0x80, 0xFF))


def collapse(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, text, sources: array of (source, n)): every distinct text of a language once."""
    flat = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    flat = flat.withColumn("h", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    copies = flat.groupBy("lang", "h", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.groupBy("lang", "h").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    once = flat.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return once.join(copies, ["lang", "h"]).select("lang", "text", "sources")


def _add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[at], *[np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _slice_counts(piece, lang, source_of, sources, times, source_names, lang_names, max_rows):
    """Tables (lang, source, term, n, d) of one slice of texts."""
    at = words(piece, LETTERS)
    if not len(at.starts):
        return
    inside = LETTERS[piece.data]
    inside[piece.ends] = False
    ends = np.concatenate([[0], np.cumsum(at.ends - at.starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(piece.data[inside])])
    found = found.dictionary_encode()
    code, names = found.indices.to_numpy().astype(np.int64), found.dictionary
    doc = np.repeat(np.arange(len(piece.starts)), np.diff(at.first))
    key, n = np.unique(doc * len(names) + code, return_counts=True)
    doc, term = key // len(names) + piece.first, key % len(names)
    copies = source_of[doc + 1] - source_of[doc]
    cut = np.searchsorted(np.cumsum(copies), np.arange(4 * max_rows, int(copies.sum()) + 4 * max_rows, 4 * max_rows))
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]])):
        if a == b:
            continue
        d, k = doc[a:b], copies[a:b]
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(source_of[d], k)
        t = times[place]
        group = (np.repeat(lang[d], k) * len(source_names) + sources[place]) * len(names) + np.repeat(term[a:b], k)
        group, total, docs = _add_up(group, np.repeat(n[a:b], k) * t, t)
        group, term_at = group // len(names), group % len(names)
        yield pa.table({"lang": lang_names.take(pa.array(group // len(source_names))),
                        "source": source_names.take(pa.array(group % len(source_names))),
                        "term": names.take(pa.array(term_at)), "n": total, "d": docs})


def _combined(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "d"])


def _counts(max_rows: int):
    """(lang, source, term, n: occurrences, d: documents), combined within a task."""
    def run(batches):
        held, rows, combined = [], 0, 0
        for batch in batches:
            lists = batch.column("sources")
            flat = lists.flatten()
            source = flat.field("source").cast(pa.large_string()).dictionary_encode()
            lang = batch.column("lang").cast(pa.large_string()).dictionary_encode()
            offsets = np.asarray(lists.offsets).astype(np.int64)
            for piece in slices(batch.column("text")):
                for table in _slice_counts(piece, lang.indices.to_numpy().astype(np.int64), offsets - offsets[0],
                                           source.indices.to_numpy().astype(np.int64), np.asarray(flat.field("n")).astype(np.int64),
                                           source.dictionary, lang.dictionary, max_rows):
                    held.append(table)
                    rows += table.num_rows
                    if rows > 2 * combined + max_rows:
                        held = [_combined(held)]
                        rows = combined = held[0].num_rows
                        if rows > max_rows:
                            yield from held[0].combine_chunks().to_batches()
                            held, rows, combined = [], 0, 0
        if held:
            yield from _combined(held).combine_chunks().to_batches()

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, n_docs, total, sources: array of (source, n)) of the terms that a language keeps."""
    counted = collapse(docs, text, lang, source).mapInArrow(_counts(ROWS), "lang string, source string, term string, n long, d long")
    # combined in the tasks already: one shuffle serves both sums, with at most a row a task and source for a term
    counted = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = counted.groupBy("lang", "term").agg(F.sum("d").alias("n_docs"), F.sum("n").alias("total"),
                                               F.collect_list(F.struct("source", "n")).alias("sources"))
    return kept.where(F.col("n_docs") >= min_docs).checkpoint()


def _share(count: Column | str, n: str, v: str = "v") -> Column:
    """p of a count; 0 where a language keeps no term."""
    exact = [F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)") for c in (count, n, v)]
    parts = F.struct(((exact[0] + SMOOTH) * SCALE).alias("a"), (exact[1] + SMOOTH * exact[2]).alias("b"))
    whole = F.transform(F.array(parts), lambda x: F.call_function("div", x["a"], x["b"]) + 1)
    return F.when(F.col(v) > 0, F.get(whole, F.lit(0))).otherwise(F.lit(0)).cast("long")


def _both(max_rows: int):
    """(lang, a, b, value): what terms of two sources change, summed over the terms of a task, a < b."""
    def run(batches):
        held: dict[str, list] = {}
        rows = 0

        def emit():
            for name, parts in held.items():
                width = max(int(w) for w, _, _ in parts)
                keys = np.concatenate([k // w * width + k % w for w, k, _ in parts])
                keys, value = _add_up(keys, np.concatenate([v for _, _, v in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys // width, pa.int32()),
                                                  pa.array(keys % width, pa.int32()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])
            held.clear()

        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            names, of_row = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            lists = batch.column("x")
            flat = lists.flatten()
            offsets = np.asarray(lists.offsets).astype(np.int64)
            row = np.repeat(np.arange(len(of_row)), np.diff(offsets))
            i, p, z = (np.asarray(flat.field(c)).astype(np.int64) for c in ("i", "p", "z"))
            group, width = of_row[row], int(i.max(initial=0)) + 1
            step = 1
            while (near := np.flatnonzero(row[step:] == row[:-step])).size:  # entries that far apart in one term's list
                a, b = near, near + step
                change = np.abs(p[a] - p[b]) - np.abs(p[a] - z[b]) - np.abs(z[a] - p[b]) + np.abs(z[a] - z[b])
                key, change = _add_up((group[a] * width + i[a]) * width + i[b], change)
                for k, name in enumerate(names):
                    own = slice(*np.searchsorted(key, [k * width * width, (k + 1) * width * width]))
                    if key[own].size:
                        held.setdefault(name, []).append((width, key[own] - k * width * width, change[own]))
                        rows += key[own].size
                if rows > 4 * max_rows:
                    yield from emit()
                    rows = 0
                step += 1
        yield from emit()

    return run


class Audit:
    """Kept terms and groups of a table, written once; ``pairs`` and ``terms`` read them."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang", source: str = "source"):
        checkpoint_dir(docs.sparkSession)
        kept = kept_terms(docs, min_docs, text, lang, source)
        all_groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
        each = kept.select("lang", "term", "total", F.explode("sources").alias("x")).select("lang", "term", "total", "x.*")
        sums = each.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
        known = all_groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
        listed = known.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "group_n", "v", "lang_n"))).alias("x"))
        listed = listed.select("lang", F.posexplode("x").alias("i", "x")).select("lang", "i", "x.*")
        #: (lang, i, source, group_n, v, lang_n, z): i numbers a language's sources, z is the value of count 0
        self.groups = listed.withColumn("z", _share(F.lit(0), "group_n")).checkpoint()
        counted = each.join(self.groups, ["lang", "source"])
        #: (lang, source, i, term, n, p, q, z): what the groups have of the kept terms
        self.counts = counted.select("lang", "source", "i", "term", "n", _share("n", "group_n").alias("p"),
                                     _share("total", "lang_n").alias("q"), "z").checkpoint()

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): every two sources of a language, both ways round."""
        lists = self.counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("i", "p", "z"))).alias("x"))
        both = lists.select("lang", "x").mapInArrow(_both(ROWS), "lang string, a int, b int, value long")
        values = self.counts.groupBy("lang", "i", "p").agg(F.count(F.lit(1)).alias("n"))
        values = values.groupBy("lang", "i").agg(F.collect_list(F.struct("p", "n")).alias("have"))
        others = self.groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "z"))).alias("others"))
        rows = self.groups.join(values, ["lang", "i"], "left").join(others, "lang")
        zero = F.lit(0).cast("long")
        none = F.array().cast(dict(values.dtypes)["have"])
        rows = rows.select("lang", "v", F.col("i").alias("a"), "z", F.coalesce("have", none).alias("have"), F.explode("others").alias("o"))
        rows = rows.where("a <> o.i").withColumn("apart", F.abs(F.col("z") - F.col("o.z")))
        one = F.aggregate(F.transform("have", lambda h: (F.abs(h["p"] - F.col("o.z")) - F.col("apart")) * h["n"]), zero, lambda s, x: s + x)
        # half of V |z - z'| comes from either way round: counted where a < b
        one = rows.select("lang", "a", F.col("o.i").alias("b"), (
            one + F.when(F.col("a") < F.col("o.i"), F.col("v") * F.col("apart")).otherwise(zero)).alias("value"))
        half = one.unionByName(both)
        whole = half.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
        ways = whole.unionByName(whole.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        name = self.groups.select("lang", F.col("i"), "source")
        first = name.select("lang", F.col("i").alias("a"), "source")
        return ways.join(first, ["lang", "a"]).join(name.select("lang", F.col("i").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select(
            "lang", "source", "item", "value")

    def terms(self) -> DataFrame:
        """(lang, source, item, value): the terms that a source has more of than its language."""
        return self.counts.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def digest(audit: Audit, top: int = TOP) -> DataFrame:
    """Ranked pairs, and the ``top`` terms of every group."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (audit.pairs(), audit.terms())]
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for x, part in zip(ranked, ("pair", "term"))]
    return out[0].unionByName(out[1].where(F.col("rank") <= top))
