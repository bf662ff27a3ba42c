"""Plans for the scan pipeline and scan-table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailsieve.functions import signals as S
from mailsieve.functions import text as T
from mailsieve.operators import scans as SC
from mailsieve.operators.classify import parsed_from_view
from mailsieve.operators.scan_store import ScanStore
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import EMAIL_VIEW, rules_cte, sql_auth, sql_domain, sql_extract_urls, sql_iso, sql_short_id
from mailsieve.session import checkpoint_dir
from mailsieve.sources.tables import email_view, pasted_texts

CUTOFF = "2024-01-15 00:00:00"  # e-mails seen before this instant form the stored table


def _flags_sql(src: str) -> str:
    """M2 columns over a parsed relation ``src`` (one row per input row)."""
    ip = r"(?i)^https?://([^/?#]*@)?([0-9]{1,3}\.){3}[0-9]{1,3}(:[^/?#]*)?([/?#]|$)"
    return f"""fp AS (
  SELECT *, list_sort(list_distinct({sql_extract_urls('body_text')})) AS urls,
    {sql_domain('sender')} AS sd, {sql_domain('reply_to')} AS rd, {sql_domain('return_path')} AS pd,
    {sql_auth('auth_results', 'spf')} AS spf, {sql_auth('auth_results', 'dkim')} AS dkim,
    {sql_auth('auth_results', 'dmarc')} AS dmarc
  FROM {src}
), flags AS (
  SELECT *, 0 AS has_html, CAST(coalesce(body_text, '') <> '' AS INTEGER) AS has_text,
    CAST(len(urls) AS INTEGER) AS urls_count,
    CAST(len(list_filter(urls, lambda u: regexp_matches(u, '{ip}'))) > 0 AS INTEGER) AS url_has_ip,
    CAST(len(list_filter(urls, lambda u: contains(u, 'xn--'))) > 0 AS INTEGER) AS url_has_punycode,
    CAST(sd <> '' AND rd <> '' AND sd <> rd AS INTEGER) AS reply_to_mismatch,
    CAST(sd <> '' AND pd <> '' AND sd <> pd AS INTEGER) AS return_path_mismatch,
    CAST(coalesce(spf, '') = 'fail' AS INTEGER) AS spf_fail,
    CAST(coalesce(dkim, '') = 'fail' AS INTEGER) AS dkim_fail,
    CAST(coalesce(dmarc, '') = 'fail' AS INTEGER) AS dmarc_fail
  FROM fp
)"""


FLAG_COLS = ("has_html, has_text, urls_count, url_has_ip, url_has_punycode, reply_to_mismatch, "
             "return_path_mismatch, spf_fail, dkim_fail, dmarc_fail")


def scans_sql(batch_where: str = "TRUE", existing_where: str | None = None) -> str:
    """CTEs ending in ``scans`` (and ``new_emails``) for the rules-only batch scan."""
    ex = ""
    cur = "surv"
    if existing_where:
        ex = f""", ex AS (
  SELECT email_id, arg_min(body_text, doc_id) AS body_text, arg_min(subject, doc_id) AS subject,
         arg_min(sender, doc_id) AS sender, arg_min(message_id, doc_id) AS message_id
  FROM p0 WHERE {existing_where} GROUP BY email_id
), new_emails AS (SELECT * FROM surv WHERE email_id NOT IN (SELECT email_id FROM ex)),
cur AS (SELECT * FROM ex WHERE email_id IN (SELECT email_id FROM surv) UNION ALL SELECT * FROM new_emails)"""
        cur = "cur"
    else:
        ex = ", new_emails AS (SELECT * FROM surv)"
    return f"""WITH {EMAIL_VIEW},
p0 AS (SELECT *, {sql_short_id('message_id', 'subject', 'date_hdr', 'sender')} AS email_id FROM email),
p AS (SELECT * FROM p0 WHERE {batch_where}),
surv AS (
  SELECT email_id, arg_min(body_text, doc_id) AS body_text, arg_min(subject, doc_id) AS subject,
         arg_min(sender, doc_id) AS sender, arg_min(message_id, doc_id) AS message_id
  FROM p GROUP BY email_id
){ex},
{rules_cte(cur, 'body_text', 'email_id')},
{_flags_sql('p')},
scans AS (
  SELECT f.doc_id + 1 AS id, f.email_id, c.subject, c.sender, substr(c.body_text, 1, 500) AS body_preview,
         r.label, r.confidence, r.reasons, {', '.join('f.' + x.strip() for x in FLAG_COLS.split(','))},
         f.created_at, 'heuristics_only' AS fallback_reason, 'upload' AS direction
  FROM flags f JOIN {cur} c ON f.email_id = c.email_id JOIN rule r ON f.email_id = r.email_id
)"""


def _flat(scans):
    return scans.select(
        "id", "email_id", "subject", "sender", "body_preview", "label",
        F.round("confidence", 6).alias("confidence"), "reasons", "header_flags.*",
        S.iso_timestamp("created_at").alias("created_at"),
        F.col("details.fallback_reason").alias("fallback_reason"), "direction")


_FLAT_SQL = (f"SELECT id, email_id, subject, sender, body_preview, label, round(confidence, 6) AS confidence, reasons, "
             f"{FLAG_COLS}, {sql_iso('created_at')} AS created_at, fallback_reason, direction FROM scans")


def _scans(spark, sf):
    return SC.scan_view(spark, sf)[0]


def _stored(spark, sf) -> ScanStore:
    """The scans of the view, stored below the shared checkpoint folder."""
    store = ScanStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/scans-{uuid.uuid4().hex}")
    store.append(_scans(spark, sf))
    return store


@register("m05_scan_batch", scans_sql() + " " + _FLAT_SQL)
def m05_scan_batch(spark, sf):
    return _flat(_scans(spark, sf))


@register("m05_scan_summary", scans_sql() + """ SELECT label, count(*) AS n_scans,
  count(DISTINCT email_id) AS n_emails, round(avg(confidence), 6) AS mean_confidence FROM scans GROUP BY label""")
def m05_scan_summary(spark, sf):
    return _scans(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_scans"), F.countDistinct("email_id").alias("n_emails"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def _split(spark, sf):
    """Stored e-mails = first-wins e-mails of messages before CUTOFF; batch = the rest."""
    v = parsed_from_view(email_view(spark, sf))
    before = F.col("created_at") < F.lit(CUTOFF).cast("timestamp")
    _, stored = SC.scan_emails(v.where(before))
    return v.where(~before), stored


@register("c01_insert_if_absent", scans_sql(f"created_at >= TIMESTAMP '{CUTOFF}'", f"created_at < TIMESTAMP '{CUTOFF}'")
          + " SELECT email_id AS id, message_id, subject, sender, sha256(body_text) AS body_sha FROM new_emails")
def c01_insert_if_absent(spark, sf):
    batch, stored = _split(spark, sf)
    _, new = SC.scan_emails(batch, existing_emails=stored)
    return new.select("id", "message_id", "subject", "sender", T.sha256_hex("body_text").alias("body_sha"))


@register("c02_score_survivor", scans_sql(f"created_at >= TIMESTAMP '{CUTOFF}'", f"created_at < TIMESTAMP '{CUTOFF}'")
          + " " + _FLAT_SQL)
def c02_score_survivor(spark, sf):
    batch, stored = _split(spark, sf)
    scans, _ = SC.scan_emails(batch, existing_emails=stored)
    return _flat(scans)


@register("c03_scan_email_join", scans_sql() + """ SELECT s.id, s.email_id, e.message_id, s.label,
  sha256(e.body_text) AS email_body_sha FROM scans s LEFT JOIN new_emails e ON s.email_id = e.email_id""")
def c03_scan_email_join(spark, sf):
    scans, emails = SC.scan_view(spark, sf)
    e = emails.select(F.col("id").alias("email_id"), "message_id", T.sha256_hex("body_text").alias("email_body_sha"))
    return scans.select("id", "email_id", "label").join(e, "email_id", "left").select(
        "id", "email_id", "message_id", "label", "email_body_sha")


@register("c04_cascade_delete", scans_sql() + """ SELECT id, email_id, label FROM scans WHERE email_id NOT IN
  (SELECT email_id FROM new_emails WHERE lower(regexp_extract(sender, '@([A-Za-z0-9.-]+)', 1)) = 'host0.example.com')""")
def c04_cascade_delete(spark, sf):
    scans, emails = SC.scan_view(spark, sf)
    deleted = emails.where(S.domain_of("sender") == "host0.example.com").select("id")
    return SC.cascade_delete(scans, deleted).select("id", "email_id", "label")


@register("c05_point_lookup", scans_sql() + " " + _FLAT_SQL.replace("FROM scans", "FROM scans WHERE id = 42"))
def c05_point_lookup(spark, sf):
    """C5 on stored scans: partition and row-group pruning by the rank index, the id pushed down to the bloom filter."""
    return _flat(_stored(spark, sf).lookup(42))


@register("f01_page_scans", scans_sql() + """, cnt AS (SELECT count(*) AS n FROM scans),
pg AS (SELECT least(3, greatest(1, CAST(ceil(n / 10.0) AS BIGINT))) AS page FROM cnt),
ranked AS (SELECT id, email_id, label, round(confidence, 6) AS confidence, row_number() OVER (ORDER BY id DESC) AS rn FROM scans)
SELECT id, email_id, label, confidence FROM ranked, pg WHERE rn > (page - 1) * 10 AND rn <= page * 10""")
def f01_page_scans(spark, sf):
    """F1 on stored scans: the page is one range of the rank index."""
    rows, _ = _stored(spark, sf).page(3, 10)
    return rows.select("id", "email_id", "label", F.round("confidence", 6).alias("confidence"))


@register("f02_sort_desc", scans_sql() + " SELECT id, label FROM scans ORDER BY id DESC")
def f02_sort_desc(spark, sf):
    return _scans(spark, sf).select("id", "label").orderBy(F.desc("id"))


_EXPORT_SQL = scans_sql() + f""" SELECT id, {sql_iso('created_at')} AS created_at,
  CASE WHEN substr(subject, 1, 1) IN ('=', '+', '-', '@') THEN '''' || subject ELSE subject END AS subject,
  CASE WHEN substr(sender, 1, 1) IN ('=', '+', '-', '@') THEN '''' || sender ELSE sender END AS sender,
  label, round(confidence, 6) AS confidence, reasons FROM scans
  WHERE label = 'phishing' AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY
  ORDER BY id DESC"""


@register("a15_export_rows", _EXPORT_SQL)
def a15_export_rows(spark, sf):
    e = SC.export_rows(_scans(spark, sf), label="phishing", date_from="2024-01-03", date_to="2024-1-20")
    return e.withColumn("confidence", F.round("confidence", 6))


@register("b07_label_filter", scans_sql() + " SELECT id, email_id FROM scans WHERE label = 'spam'")
def b07_label_filter(spark, sf):
    return SC.filter_scans(_scans(spark, sf), label="spam").select("id", "email_id")


@register("b08_date_range", scans_sql() + """ SELECT id, label FROM scans
  WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-12' + INTERVAL 1 DAY""")
def b08_date_range(spark, sf):
    """B8 on stored scans: the dates are a partition filter."""
    return _stored(spark, sf).between("2024-01-10", "2024-01-12").select("id", "label")


@register("b12_confidence_check", scans_sql() + """ SELECT id, round(confidence + 1.0, 6) AS confidence FROM scans
  WHERE id % 7 = 0 AND confidence + 1.0 > 1.0""")
def b12_confidence_check(spark, sf):
    s = _scans(spark, sf)
    # every seventh confidence is moved out of the range
    s = s.withColumn("confidence", F.col("confidence") + F.when(F.col("id") % 7 == 0, 1.0).otherwise(0.0))
    return SC.confidence_violations(s).select("id", F.round("confidence", 6).alias("confidence"))


@register("b14_recipients", f"""WITH {EMAIL_VIEW} SELECT doc_id,
  regexp_replace(reply_to || ';' || '' || ';' || return_path, '^;+|;+$', '', 'g') AS recipients FROM email""")
def b14_recipients(spark, sf):
    return email_view(spark, sf).select("doc_id", S.recipients("reply_to", F.lit(""), "return_path").alias("recipients"))


@register("b18_scan_payload", scans_sql() + f""" SELECT id, label, round(confidence, 6) AS confidence,
  CAST(CASE WHEN reasons = '' THEN 0 ELSE len(string_split(reasons, ', ')) END AS INTEGER) AS n_reasons,
  {sql_iso('created_at')} AS created_at FROM scans""")
def b18_scan_payload(spark, sf):
    p = SC.payload(_scans(spark, sf))
    return p.select("id", "label", F.round("confidence", 6).alias("confidence"),
                    F.size("reasons").alias("n_reasons"), "created_at")


@register("x04_counts_per_label_day", scans_sql() + """ SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, label,
  count(*) AS n FROM scans GROUP BY 1, 2""")
def x04_counts_per_label_day(spark, sf):
    return SC.counts_per_label_day(_scans(spark, sf)).select(F.col("day").cast("string").alias("day"), "label", "n")


_PASTED_SQL = f"""WITH req AS (
  SELECT conv_id * 1000 + turn AS req_id, text, 'Conversation ' || CAST(conv_id AS VARCHAR) AS subject,
         'u' || CAST(conv_id AS VARCHAR) || '@chat.example.com' AS sender FROM conversations WHERE role = 'user'
), p AS (SELECT *, {sql_short_id("''", 'subject', "''", 'sender')} AS email_id FROM req),
surv AS (SELECT email_id, arg_min(text, req_id) AS body_text FROM p GROUP BY email_id),
{rules_cte('surv', 'body_text', 'email_id')}
SELECT p.req_id AS id, p.email_id, r.label, round(r.confidence, 6) AS confidence, r.reasons,
  CAST(coalesce(p.text, '') <> '' AS INTEGER) AS has_text
FROM p JOIN rule r ON p.email_id = r.email_id"""


@register("b17_scan_pasted_texts", _PASTED_SQL)
def b17_scan_pasted_texts(spark, sf):
    """B17 text-only requests (no headers): pasted texts sharing subject+sender share an e-mail (Q7)."""
    req = pasted_texts(spark, sf)
    parsed = req.select(
        "req_id", F.col("text").alias("body_text"), "subject", "sender")  # the operator supplies every other column
    scans, _ = SC.scan_emails(parsed, order="req_id", scan_id="req_id", created_at=None)
    return scans.select("id", "email_id", "label", F.round("confidence", 6).alias("confidence"), "reasons",
                        F.col("header_flags.has_text").alias("has_text"))


@register("t01_stream_scan", scans_sql() + " SELECT id, label FROM scans")
def t01_stream_scan(spark, sf):
    """T1 + T2: ``documents`` drained as a stream into tables in the shared checkpoint folder; equal to the batch scan."""
    from mailsieve.streaming.scan_stream import start_view_stream

    out = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    start_view_stream(spark, sf, f"{out}/emails", f"{out}/scans", checkpoint=f"{out}/offsets").awaitTermination()
    return spark.read.parquet(f"{out}/scans").select("id", "label")
