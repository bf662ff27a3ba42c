"""Plans for the RFC-822 parse and corpus text jobs.

Input: RFC-822 messages that Spark builds from the derived e-mail view (one
per document, ``sources.mail.rfc822_from_view``), so the parse runs on real
bytes that grow with the tables; the oracle reads the same fields from the view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions import text as T
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import EMAIL_VIEW, sql_auth, sql_extract_urls, sql_normalize, sql_strip
from mailsieve.sources import mail as ML
from mailsieve.sources.tables import email_view


def _messages(spark, sf):
    return ML.rfc822_from_view(email_view(spark, sf))


def _doc_id():
    return F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("doc_id")


# M3 body of a message form: HTML alone is read as text (white space collapsed), the last forms add or leave out chars
_FORM = "doc_id % 9"
_ASCII = r"regexp_replace(body_text, '[^\x00-\x7F]', '', 'g')"
_BODY = f"""CASE {_FORM} WHEN 3 THEN {sql_normalize('body_text', lower=False)} WHEN 5 THEN body_text || chr(1) || ' end'
  WHEN 6 THEN body_text || chr(10) || 'boundary=zz' || chr(10) || '--zz' || chr(10) || 'after'
  WHEN 7 THEN 'It’s 5 € ' || {_ASCII} WHEN 8 THEN 'Привет ' || {_ASCII} ELSE body_text END"""
_CORPUS = sql_strip(_BODY)
_TYPE = f"CASE {_FORM} WHEN 2 THEN 'multipart/mixed' WHEN 5 THEN 'multipart/mixed' WHEN 6 THEN 'multipart/mixed' WHEN 3 THEN 'text/html' ELSE 'text/plain' END"
_HTML = ("'<html><!-- a > b --><body><p>' || replace(replace(replace(body_text, '&', '&amp;'), '<', '&lt;'), '>', '&#62;') "
         "|| '</p></body></html>'")


@register("m03_parse_rfc822", f"""WITH {EMAIL_VIEW}, m AS (SELECT *, {_BODY} AS body,
  CASE WHEN {_FORM} IN (2, 3) THEN {_HTML} ELSE '' END AS html FROM email)
SELECT doc_id, CASE WHEN {_FORM} = 8 THEN 'Привет ' ELSE '' END || subject AS subject, sender, message_id, reply_to,
  {sql_auth('auth_results', 'spf')} AS spf_result, {sql_auth('auth_results', 'dkim')} AS dkim_result,
  {sql_auth('auth_results', 'dmarc')} AS dmarc_result,
  '1.2.3.' || CAST(doc_id % 250 AS VARCHAR) || ',10.0.0.' || CAST(doc_id % 3 AS VARCHAR) AS received_ips,
  array_to_string(list_sort(list_distinct(list_concat({sql_extract_urls('body')}, {sql_extract_urls('html')}))), ' ') AS urls,
  CASE WHEN {_FORM} = 3 THEN 0 ELSE 1 END AS has_text, CASE WHEN {_FORM} IN (2, 3) THEN 1 ELSE 0 END AS has_html,
  CASE WHEN {_FORM} IN (2, 5, 6) THEN 1 ELSE 0 END AS attachments_count,
  CASE {_FORM} WHEN 2 THEN 'a b.pdf' WHEN 5 THEN 'long name.txt' WHEN 6 THEN 'naïve b.txt' ELSE '' END AS attachments,
  sha256(body) AS body_sha FROM m""")
def m03_parse_rfc822(spark, sf):
    p = ML.parse_rfc822(_messages(spark, sf))
    return p.select(_doc_id(), "subject", "sender", "message_id", "reply_to", "spf_result", "dkim_result",
                    "dmarc_result", F.array_join("received_ips", ",").alias("received_ips"),
                    F.array_join("urls", " ").alias("urls"), "has_text", "has_html",
                    F.col("attachments_count").cast("int").alias("attachments_count"),
                    F.array_join("attachments", ",").alias("attachments"), T.sha256_hex("body_text").alias("body_sha"))


@register("m04_corpus_text", f"""WITH {EMAIL_VIEW} SELECT doc_id, sha256({_CORPUS}) AS text_sha,
  CAST(length({_CORPUS}) AS INTEGER) AS len_chars FROM email""")
def m04_corpus_text(spark, sf):
    d = ML.decode_messages(_messages(spark, sf))
    t = T.strip(T.clean_newlines(F.coalesce(ML.corpus_text(), F.lit(""))))
    return d.select(_doc_id(), T.sha256_hex(t).alias("text_sha"), F.length(t).cast("int").alias("len_chars"))


# listing facts derived from doc_id: archives, oversize files and unmapped folders (no label)
_FILE_STATUS = """CASE WHEN doc_id % 11 = 0 THEN 'archive' WHEN octet_length(encode(body_text)) > 20000 THEN 'oversize'
  WHEN doc_id % 13 = 0 THEN 'unlabelled' WHEN t = '' THEN 'empty' WHEN length(t) < 200 THEN 'short' ELSE 'ok' END"""


@register("d04_parse_counters", f"""WITH {EMAIL_VIEW}, s AS (SELECT source, {_FILE_STATUS} AS st FROM (SELECT *, {_CORPUS} AS t FROM email))
SELECT source, count(*) AS files_seen, CAST(count_if(st = 'archive') AS BIGINT) AS archives_skipped,
  CAST(count_if(st = 'oversize') AS BIGINT) AS oversize_skipped, CAST(count_if(st = 'not chosen') AS BIGINT) AS not_chosen,
  CAST(count_if(st IN ('unlabelled', 'ok', 'empty', 'short')) AS BIGINT) AS candidates,
  CAST(count_if(st = 'unlabelled') AS BIGINT) AS unlabelled, CAST(count_if(st = 'ok') AS BIGINT) AS extracted_ok,
  CAST(count_if(st = 'empty') AS BIGINT) AS empty_after_parse, CAST(count_if(st = 'short') AS BIGINT) AS too_short FROM s GROUP BY source""")
def d04_parse_counters(spark, sf):
    """The gates of the listing (a size and a name per message), then the parse of the candidates, in one pass."""
    v = email_view(spark, sf)
    i = F.col("doc_id")
    name = F.concat(F.lit("doc/"), i.cast("string"), F.when(i % 11 == 0, F.lit(".tar.gz")).otherwise(F.lit("")))
    files = ML.file_status(v.select(
        "doc_id", "source", name.alias("path"), F.octet_length(F.encode("body_text", "UTF-8")).alias("length")), 20_000)
    msgs = ML.rfc822_from_view(v).select(_doc_id(), "content")
    label = F.when(i % 13 != 0, F.lit("safe"))
    decoded = ML.decode_messages(msgs).select("doc_id", label.alias("label"), T.strip(T.clean_newlines(
        F.coalesce(ML.corpus_text(), F.lit("")))).alias("body_text"))
    parsed = ML.with_parse_status(decoded, 200).select("doc_id", F.col("status").alias("parsed"))
    both = files.join(parsed, "doc_id", "left").withColumn("status", F.when(
        F.col("status") == "candidate", F.col("parsed")).otherwise(F.col("status")))
    return ML.count_statuses(both)


@register("a20_sniff_content_type", f"WITH {EMAIL_VIEW} SELECT doc_id, {_TYPE} AS content_type FROM email")
def a20_sniff_content_type(spark, sf):
    return _messages(spark, sf).select(_doc_id(), ML.sniff_content_type("content").alias("content_type"))


@register("d05_content_type_top10", f"WITH {EMAIL_VIEW} SELECT {_TYPE} AS content_type, count(*) AS n FROM email GROUP BY 1 "
          "ORDER BY n DESC, content_type LIMIT 10")
def d05_content_type_top10(spark, sf):
    c = _messages(spark, sf).select(ML.sniff_content_type("content").alias("content_type"))
    return c.groupBy("content_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "content_type").limit(10)
