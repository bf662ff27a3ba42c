"""Corpus preparation: filters, labels, exact dedupe, reports.

Keep-first needs an explicit order column: files and partitions have no
stable row order in Spark, so callers pass ``order`` (e.g. source rank then
doc id).  Dedupe is a hash aggregate of the smallest order per key on narrow
rows; the survivors' payload is fetched by a join on (keys, order), which spreads
a group of copies over all tasks because the order differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.constants import BINARY_MAP, CLASSES, LABEL_ALIASES
from mailsieve.functions.text import _c, extract_body, normalize_text, sha256_hex, strip

CORPUS_COLUMNS = ("body_text", "label", "source", "relpath", "len_chars", "source_file")


def canonical_label(x) -> Column:
    """Strip + lower, then the alias table; unknown labels pass through; null stays null."""
    k = F.lower(strip(_c(x)))
    m = F.create_map(*[F.lit(v) for kv in LABEL_ALIASES.items() for v in kv])
    return F.when(_c(x).isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(m[k], k))


def binary_label(x) -> Column:
    """Safe stays safe; spam and phishing become not_safe."""
    m = F.create_map(*[F.lit(v) for kv in BINARY_MAP.items() for v in kv])
    return m[_c(x)]


def min_chars(df: DataFrame, n: int = 20, col: str = "body_text") -> DataFrame:
    """B1: keep rows whose stripped text has at least n characters."""
    return df.where(F.length(strip(F.col(col))) >= n)


def longer_than(df: DataFrame, n: int = 40, col: str = "body_text") -> DataFrame:
    """B2: keep rows whose text is longer than n characters."""
    return df.where(F.length(F.col(col)) > n)


def non_empty(df: DataFrame, col: str = "body_text") -> DataFrame:
    """B3"""
    return df.where(F.coalesce(F.col(col), F.lit("")) != "")


def training_rows(df: DataFrame, text: str = "body_text", label: str = "label") -> DataFrame:
    """Canonical label, stripped non-empty text, label in the three classes.

    Null text is dropped (the pandas path would have kept the string 'nan').
    """
    # a text that is not only white space; the rows that stay are stripped, not every row for the filter
    out = df.withColumn(label, canonical_label(label)).where(F.col(text).rlike(r"(?U)\S") & F.col(label).isin(*CLASSES))
    return out.withColumn(text, strip(F.col(text)))


def training_rows_report(df: DataFrame, text: str = "body_text", label: str = "label") -> DataFrame:
    """B5 counts: rows in, kept, dropped (one aggregate pass)."""
    lab = canonical_label(label)
    ok = F.col(text).isNotNull() & (strip(F.col(text)) != "") & lab.isin(*CLASSES)
    return df.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(ok).alias("n_kept"),
                  F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_dropped"))


def first_per_key(rows: DataFrame, keys: list[str], order: str, *more: Column) -> DataFrame:
    """E1 core: the row with the smallest ``order`` per key (null keys are one key); ``more`` adds aggregates per key.

    ``order`` is unique per key; rows without an order are never first.
    """
    low = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(order).alias("__order"), *more)
    same = F.col(order) == F.col("__order")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(low, same).drop("__order", *[f"__{k}" for k in keys])


def with_text_hash(df: DataFrame, text: str = "body_text", normalized: bool = True, out: str = "text_hash") -> DataFrame:
    """H1+H3 key: SHA-256 of the normalised (or raw) text."""
    t = normalize_text(text) if normalized else F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, sha256_hex(t))


def dedupe_keep_first(df: DataFrame, order: str, text: str = "body_text", label: str | None = "label",
                      normalized: bool = True) -> DataFrame:
    """E1 (key = normalised-text hash + label) / E2 (raw-text hash, ``label=None``)."""
    h = with_text_hash(df, text, normalized)
    keys = ["text_hash"] + ([label] if label else [])
    return first_per_key(h, keys, order)


def dedupe_report(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """D3: per label rows before / after and removed, plus an ``__all__`` total row."""
    b = before.groupBy(label).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).alias("n_after"))
    per = b.join(a, [label], "full").select(
        F.col(label).alias("label"), F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"))
    tot = per.agg(F.lit("__all__").alias("label"), F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
    return per.unionByName(tot).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def counts_per_label(df: DataFrame, label: str = "label") -> DataFrame:
    """D2"""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def resolve_conflicts(df: DataFrame, order: str, text: str = "body_text", label: str = "label") -> DataFrame:
    """One row per raw-body hash; 'spam' wins when the copies disagree, else the first label."""
    h = with_text_hash(df, text, normalized=False)
    out = first_per_key(h, ["text_hash"], order, F.max((F.col(label) == "spam").cast("int")).alias("__any_spam"))
    return out.withColumn(label, F.when(F.col("__any_spam") == 1, F.lit("spam")).otherwise(F.col(label))).drop("__any_spam")


def union_corpora(*dfs: DataFrame) -> DataFrame:
    """G1: union by column name; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def tidy_columns(df: DataFrame, wanted=CORPUS_COLUMNS) -> DataFrame:
    """The output columns that exist, in the canonical order."""
    return df.select(*[c for c in wanted if c in df.columns])


def fill_len_chars(df: DataFrame, text: str = "body_text") -> DataFrame:
    """``len_chars`` from the normalised text when the column is missing."""
    if "len_chars" in df.columns:
        return df
    return df.withColumn("len_chars", F.length(normalize_text(text)).cast("int"))


def body_rows(df: DataFrame, raw: str = "raw_text", min_len: int = 40) -> DataFrame:
    """Prep-script body rule: body after the first blank line, kept when longer than ``min_len``."""
    return longer_than(df.withColumn("body_text", extract_body(raw)), min_len)
