"""Views over the supplied tables.

The raw ``documents`` table holds no URLs, headers or rule phrases, so the
e-mail operators run on a *derived e-mail view*: every column is a pure
function of ``doc_id`` and ``text`` (labels are joined only where they are read), so the work
grows with the table and the same view can be restated in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.session import read_table

# FIXED VALUES: snippet appended to document i is SNIPPETS[i % 8]; together they
# reach every branch of the rule classifier.
SNIPPETS = (
    "",
    "Urgent: login now",
    "See http://192.168.10.5/login immediately",
    "Special offer, act now",
    "Visit https://xn--pple-43d.com/ for details",
    "Limited time: unsubscribe at https://xn--80ak6aa92e.com",
    "Final notice http://10.0.0.1 https://xn--a.com update your password",
    "Notes at HTTPS://example.org/a, and (http://example.com/b).",
)
# FIXED VALUES: header fragments selected by doc_id arithmetic
REPLY_TO = ("help@other.example.net", "x@host1.example.com", "")
AUTH_RESULTS = (
    "",
    "mx; spf=pass; dkim=pass; dmarc=pass",
    "mx; spf=fail smtp.mailfrom=a; dkim=pass",
    "mx; SPF=SoftFail; DKIM = fail; dmarc=FAIL; spf=pass",
)
BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def _pick(idx: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def _s(c: Column) -> Column:
    return c.cast("string")


def email_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed-message view (one row per document) with the PARSED columns used downstream."""
    return email_view_of(read_table(spark, sf_dir, "documents"))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_label) of the labelled documents."""
    return read_table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, F.lit(" Phish ")).when(F.col("quality") == 0, F.lit("SPAM"))
        .otherwise(F.lit("ham")).alias("raw_label"))


def labelled_email_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-mail view and ``raw_label``.  labels grows with documents: no forced broadcast."""
    return email_view(spark, sf_dir).join(raw_labels(spark, sf_dir), "doc_id", "left")


def email_view_of(documents: DataFrame) -> DataFrame:
    """The e-mail view over any ``documents`` relation (batch or stream); a projection, no join."""
    i = F.col("doc_id")
    return documents.select(
        i.alias("doc_id"),
        F.when(i % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("<"), _s(i), F.lit("@mx.example.com>"))).alias("message_id"),
        F.concat(F.lit("Subject "), _s(i % 4)).alias("subject"),
        F.concat(F.lit("user"), _s(i % 5), F.lit("@Host"), _s(i % 3), F.lit(".example.com")).alias("sender"),
        _pick(i % 3, REPLY_TO).alias("reply_to"),
        F.when(i % 4 == 0, F.lit("<b@bounce.example.org>")).otherwise(F.lit("")).alias("return_path"),
        _pick(i % 4, AUTH_RESULTS).alias("auth_results"),
        F.concat(F.lit("from a (1.2.3."), _s(i % 250), F.lit(") by b; from c (10.0.0."), _s(i % 3), F.lit(") by d (1.2.3."),
                 _s(i % 250), F.lit(")")).alias("received"),
        F.lit("").alias("date_hdr"),
        F.concat(F.col("text"), F.lit(" "), _pick(i % 8, SNIPPETS)).alias("body_text"),
        F.col("source"),
        F.timestamp_seconds(F.lit(BASE_EPOCH) + i * 3600).alias("created_at"),
        ((i * 37) % 101 / F.lit(100.0)).alias("p_pos"),
    )


def corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled-corpus rows (doc_id, body_text, label, source, relpath, len_chars).

    ``body_text`` is the raw document text (it has exact and near copies);
    ``label`` is the raw label string (null when the document is unlabelled).
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_labelled"))
    raw_label = (
        F.when(F.col("_labelled").isNull(), F.lit(None).cast("string"))
        .when(F.col("toxic") == 1, F.lit(" Phish "))
        .when(F.col("quality") == 0, F.lit("SPAM"))
        .otherwise(F.lit("ham"))
    )
    return d.join(lab, "doc_id", "left").select(
        "doc_id",
        F.col("text").alias("body_text"),
        raw_label.alias("label"),
        F.col("source"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("relpath"),
        F.length("text").cast("int").alias("len_chars"),
    )


def chat_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second corpus from ``conversations`` (no label, no len_chars column)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.col("text").alias("body_text"),
        F.lit("chat").alias("source"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("relpath"),
    )


def pasted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted-text scan requests from ``conversations`` (user turns)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("req_id"),
        F.col("text"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("subject"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("@chat.example.com")).alias("sender"),
    )
