"""Plans for corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions import text as T
from mailsieve.operators import corpus as C
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import CORPUS_VIEW, TRAIN_VIEW, sql_canonical, sql_normalize, sql_strip
from mailsieve.session import read_table
from mailsieve.sources.tables import chat_corpus, corpus_view


def _train(spark, sf):
    return C.training_rows(corpus_view(spark, sf))


@register("b01_min_chars_20", f"SELECT conv_id, turn, CAST(length({sql_strip('text')}) AS INTEGER) AS n_chars FROM conversations "
          f"WHERE length({sql_strip('text')}) >= 20")
def b01_min_chars_20(spark, sf):
    c = read_table(spark, sf, "conversations")
    return C.min_chars(c, 20, "text").select("conv_id", "turn", F.length(T.strip("text")).cast("int").alias("n_chars"))


_BODY = ("CASE WHEN strpos(text, chr(10) || chr(10)) > 0 THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) "
         "ELSE text END")


@register("b02_body_longer_than_40", f"SELECT conv_id, turn, CAST(length(b) AS INTEGER) AS n_chars FROM "
          f"(SELECT conv_id, turn, {sql_strip(_BODY)} AS b FROM conversations) WHERE length(b) > 40")
def b02_body_longer_than_40(spark, sf):
    c = read_table(spark, sf, "conversations")
    b = C.body_rows(c, "text", 40)
    return b.select("conv_id", "turn", F.length("body_text").cast("int").alias("n_chars"))


@register("b03_non_empty", f"SELECT conv_id, turn FROM conversations WHERE coalesce({sql_strip('text')}, '') <> ''")
def b03_non_empty(spark, sf):
    c = read_table(spark, sf, "conversations").withColumn("t", T.strip("text"))
    return C.non_empty(c, "t").select("conv_id", "turn")


@register("b04_canonical_label", f"WITH {CORPUS_VIEW} SELECT doc_id, label AS raw_label, {sql_canonical('label')} AS label FROM corpus")
def b04_canonical_label(spark, sf):
    c = corpus_view(spark, sf)
    return c.select("doc_id", F.col("label").alias("raw_label"), C.canonical_label("label").alias("label"))


@register("b05_training_rows_report", f"""WITH {CORPUS_VIEW}, t AS (
  SELECT body_text IS NOT NULL AND {sql_strip('body_text')} <> '' AND coalesce({sql_canonical('label')} IN ('phishing', 'safe', 'spam'), FALSE) AS ok FROM corpus)
SELECT count(*) AS n_in, CAST(count_if(ok) AS BIGINT) AS n_kept, CAST(count_if(NOT ok) AS BIGINT) AS n_dropped FROM t""")
def b05_training_rows_report(spark, sf):
    return C.training_rows_report(corpus_view(spark, sf))


@register("b05_training_rows", f"WITH {CORPUS_VIEW}, {TRAIN_VIEW} SELECT doc_id, label, sha256(body_text) AS body_sha FROM train")
def b05_training_rows(spark, sf):
    return _train(spark, sf).select("doc_id", "label", T.sha256_hex("body_text").alias("body_sha"))


@register("b06_binary_collapse", f"WITH {CORPUS_VIEW}, {TRAIN_VIEW} SELECT doc_id, label, "
          "CASE WHEN label = 'safe' THEN 'safe' ELSE 'not_safe' END AS binary_label FROM train")
def b06_binary_collapse(spark, sf):
    return _train(spark, sf).select("doc_id", "label", C.binary_label("label").alias("binary_label"))


@register("d02_count_per_label", f"WITH {CORPUS_VIEW}, {TRAIN_VIEW} SELECT label, count(*) AS n FROM train GROUP BY label")
def d02_count_per_label(spark, sf):
    return C.counts_per_label(_train(spark, sf))


_DEDUPE_SQL = f"""WITH {CORPUS_VIEW}, h AS (SELECT *, sha256({sql_normalize('body_text')}) AS text_hash FROM corpus),
d AS (SELECT text_hash, label, min(doc_id) AS doc_id FROM h GROUP BY text_hash, label)"""


@register("e01_dedupe_keep_first", _DEDUPE_SQL + " SELECT doc_id, text_hash, label FROM d")
def e01_dedupe_keep_first(spark, sf):
    d = C.dedupe_keep_first(corpus_view(spark, sf), order="doc_id")
    return d.select("doc_id", "text_hash", "label")


@register("e02_dedupe_body_hash", f"WITH {CORPUS_VIEW} SELECT min(doc_id) AS doc_id, sha256(body_text) AS text_hash "
          "FROM corpus GROUP BY sha256(body_text)")
def e02_dedupe_body_hash(spark, sf):
    d = C.dedupe_keep_first(corpus_view(spark, sf), order="doc_id", label=None, normalized=False)
    return d.select("doc_id", "text_hash")


@register("d03_dedupe_report", _DEDUPE_SQL + """, b AS (SELECT coalesce(label, '<null>') AS label, count(*) AS n_before FROM h GROUP BY 1),
a AS (SELECT coalesce(label, '<null>') AS label, count(*) AS n_after FROM d GROUP BY 1),
per AS (SELECT b.label, n_before, coalesce(n_after, 0) AS n_after FROM b LEFT JOIN a ON a.label = b.label),
al AS (SELECT * FROM per UNION ALL SELECT '__all__', CAST(sum(n_before) AS BIGINT), CAST(sum(n_after) AS BIGINT) FROM per)
SELECT label, n_before, n_after, n_before - n_after AS n_removed FROM al""")
def d03_dedupe_report(spark, sf):
    c = corpus_view(spark, sf).withColumn("label", F.coalesce("label", F.lit("<null>")))
    d = C.dedupe_keep_first(c, order="doc_id")
    return C.dedupe_report(c, d).select("label", F.col("n_before").cast("long").alias("n_before"),
                                        F.col("n_after").cast("long").alias("n_after"),
                                        F.col("n_removed").cast("long").alias("n_removed"))


@register("d06_conflict_spam_wins", f"""WITH {CORPUS_VIEW}, {TRAIN_VIEW}, b AS (
  SELECT sha256(body_text) AS text_hash, CASE WHEN label = 'safe' THEN 'safe' ELSE 'spam' END AS label, doc_id FROM train)
SELECT text_hash, min(doc_id) AS doc_id,
  CASE WHEN max(CASE WHEN label = 'spam' THEN 1 ELSE 0 END) = 1 THEN 'spam' ELSE arg_min(label, doc_id) END AS label
FROM b GROUP BY text_hash""")
def d06_conflict_spam_wins(spark, sf):
    t = _train(spark, sf).withColumn("label", F.when(F.col("label") == "safe", "safe").otherwise("spam"))
    return C.resolve_conflicts(t, order="doc_id").select("text_hash", "doc_id", "label")


@register("g01_union_corpora", f"""WITH {CORPUS_VIEW}, u AS (
  SELECT source, label, len_chars FROM corpus
  UNION ALL SELECT 'chat' AS source, NULL AS label, NULL AS len_chars FROM conversations)
SELECT source, coalesce(label, '<null>') AS label, count(*) AS n, count(len_chars) AS n_with_len FROM u GROUP BY 1, 2""")
def g01_union_corpora(spark, sf):
    u = C.union_corpora(corpus_view(spark, sf), chat_corpus(spark, sf))
    return u.groupBy("source", F.coalesce("label", F.lit("<null>")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count("len_chars").alias("n_with_len"))


@register("b16_fill_len_chars", f"SELECT conv_id * 1000 + turn AS doc_id, CAST(length({sql_normalize('text')}) AS INTEGER) AS len_chars "
          "FROM conversations")
def b16_fill_len_chars(spark, sf):
    return C.fill_len_chars(chat_corpus(spark, sf)).select("doc_id", "len_chars")


@register("a06_constant_label", "SELECT 'chat' AS source, 'safe' AS label, count(*) AS n FROM conversations")
def a06_constant_label(spark, sf):
    c = chat_corpus(spark, sf).withColumn("label", F.lit("safe"))
    return c.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
