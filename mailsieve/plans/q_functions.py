"""Plans for the scalar functions and the rule/flag operators (H*, M1, M2, G3, G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions import signals as S
from mailsieve.functions import text as T
from mailsieve.operators.classify import header_flags, parsed_from_view, with_rules
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import (
    EMAIL_VIEW,
    rules_cte,
    sql_auth,
    sql_domain,
    sql_extract_urls,
    sql_iso,
    sql_normalize,
    sql_short_id,
    sql_strip,
)
from mailsieve.session import read_table
from mailsieve.sources.tables import email_view


def _ev(spark, sf):
    return email_view(spark, sf)


@register("m01_classify_text", f"WITH {EMAIL_VIEW}, {rules_cte()} "
          "SELECT doc_id, label, round(confidence, 6) AS confidence, round(score, 6) AS rule_score, reasons FROM rule")
def m01_classify_text(spark, sf):
    r = F.col("rule")
    return with_rules(_ev(spark, sf).select("doc_id", "body_text")).select(
        "doc_id", r["label"].alias("label"), F.round(r["confidence"], 6).alias("confidence"),
        F.round(r["score"], 6).alias("rule_score"), S.reason_string(r["reasons"]).alias("reasons"))


_FLAGS_SQL = f"""WITH {EMAIL_VIEW}, p AS (
  SELECT doc_id, sender, reply_to, return_path,
    list_sort(list_distinct({sql_extract_urls('body_text')})) AS urls,
    {sql_auth('auth_results', 'spf')} AS spf, {sql_auth('auth_results', 'dkim')} AS dkim,
    {sql_auth('auth_results', 'dmarc')} AS dmarc,
    CAST(coalesce(body_text, '') <> '' AS INTEGER) AS has_text
  FROM email
), d AS (
  SELECT *, {sql_domain('sender')} AS sd, {sql_domain('reply_to')} AS rd, {sql_domain('return_path')} AS pd FROM p
)
SELECT doc_id, 0 AS has_html, has_text, CAST(len(urls) AS INTEGER) AS urls_count,
  CAST(len(list_filter(urls, lambda u: regexp_matches(u, '(?i)^https?://([^/?#]*@)?([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}(:[^/?#]*)?([/?#]|$)'))) > 0 AS INTEGER) AS url_has_ip,
  CAST(len(list_filter(urls, lambda u: contains(u, 'xn--'))) > 0 AS INTEGER) AS url_has_punycode,
  CAST(sd <> '' AND rd <> '' AND sd <> rd AS INTEGER) AS reply_to_mismatch,
  CAST(sd <> '' AND pd <> '' AND sd <> pd AS INTEGER) AS return_path_mismatch,
  CAST(coalesce(spf, '') = 'fail' AS INTEGER) AS spf_fail,
  CAST(coalesce(dkim, '') = 'fail' AS INTEGER) AS dkim_fail,
  CAST(coalesce(dmarc, '') = 'fail' AS INTEGER) AS dmarc_fail
FROM d"""


@register("m02_header_flags", _FLAGS_SQL)
def m02_header_flags(spark, sf):
    p = parsed_from_view(_ev(spark, sf))
    h = header_flags("has_html", "has_text", "urls", "sender", "reply_to", "return_path",
                     "spf_result", "dkim_result", "dmarc_result")
    return p.select("doc_id", h.alias("h")).select("doc_id", "h.*")


@register("h01_normalize_text", "SELECT doc_id, sha256(" + sql_normalize("text") + ") AS norm_sha, "
          "CAST(length(" + sql_normalize("text") + ") AS BIGINT) AS norm_len FROM documents")
def h01_normalize_text(spark, sf):
    n = T.normalize_text("text")
    return read_table(spark, sf, "documents").select("doc_id", T.sha256_hex(n).alias("norm_sha"),
                                                     F.length(n).cast("long").alias("norm_len"))


@register("h02_normalize_body", "SELECT conv_id, turn, sha256(" + sql_normalize("text", False) + ") AS norm_sha, "
          "CAST(length(" + sql_normalize("text", False) + ") AS BIGINT) AS norm_len FROM conversations")
def h02_normalize_body(spark, sf):
    n = T.normalize_body("text")
    return read_table(spark, sf, "conversations").select("conv_id", "turn", T.sha256_hex(n).alias("norm_sha"),
                                                         F.length(n).cast("long").alias("norm_len"))


@register("h03_sha256_text", "SELECT doc_id, sha256(text) AS text_sha FROM documents")
def h03_sha256_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.sha256_hex("text").alias("text_sha"))


@register("h04_short_email_id", f"WITH {EMAIL_VIEW} SELECT doc_id, "
          f"{sql_short_id('message_id', 'subject', 'date_hdr', 'sender')} AS email_id FROM email")
def h04_short_email_id(spark, sf):
    return _ev(spark, sf).select("doc_id", T.short_id("message_id", "subject", "date_hdr", "sender").alias("email_id"))


_BODY_SQL = ("SELECT conv_id, turn, sha256(" + sql_strip("CASE WHEN strpos(text, chr(10) || chr(10)) > 0 "
             "THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END") + ") AS body_sha, "
             "CAST(length(" + sql_strip("CASE WHEN strpos(text, chr(10) || chr(10)) > 0 "
             "THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END") + ") AS BIGINT) AS body_len "
             "FROM conversations")


@register("h05_extract_body", _BODY_SQL)
def h05_extract_body(spark, sf):
    b = T.extract_body("text")
    return read_table(spark, sf, "conversations").select("conv_id", "turn", T.sha256_hex(b).alias("body_sha"),
                                                         F.length(b).cast("long").alias("body_len"))


_HTML_SQL = r"""WITH a AS (
  SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
                                 '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g') AS h FROM pages
), b AS (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(h, '<[^>]+>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '),
    '&middot;', '·'), '&copy;', '©'), '&reg;', '®'), '&amp;', '&') AS t FROM a
), c AS (
  SELECT page_id, regexp_replace(regexp_replace(t || ' café ’ … A &madeup;', '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS txt FROM b
)
SELECT page_id, sha256(txt) AS text_sha, CAST(length(txt) AS BIGINT) AS text_len FROM c"""


@register("h06_html_to_text", _HTML_SQL)
def h06_html_to_text(spark, sf):
    # a comment with a tag end, named, decimal, hexadecimal and unknown references after every page
    tail = "<!-- a > b --><p>caf&eacute; &#8217; &hellip; &#x41; &madeup;</p>"
    t = T.html_to_text(F.concat(F.coalesce("html", F.lit("")), F.lit(tail)))
    return read_table(spark, sf, "pages").select("page_id", T.sha256_hex(t).alias("text_sha"),
                                                 F.length(t).cast("long").alias("text_len"))


@register("h07_extract_urls", f"WITH {EMAIL_VIEW}, u AS (SELECT doc_id, {sql_extract_urls('body_text')} AS urls FROM email) "
          "SELECT doc_id, array_to_string(urls, ' ') AS urls, CAST(len(urls) AS INTEGER) AS n_urls FROM u")
def h07_extract_urls(spark, sf):
    u = T.extract_urls("body_text")
    return _ev(spark, sf).select("doc_id", F.array_join(u, " ").alias("urls"), F.size(u).cast("int").alias("n_urls"))


@register("h08_rule_urls", f"WITH {EMAIL_VIEW}, u AS (SELECT doc_id, regexp_extract_all(body_text, 'https?://\\S+') AS urls FROM email) "
          "SELECT doc_id, array_to_string(urls, ' ') AS urls, CAST(len(urls) AS INTEGER) AS n_urls FROM u")
def h08_rule_urls(spark, sf):
    u = T.rule_urls("body_text")
    return _ev(spark, sf).select("doc_id", F.array_join(u, " ").alias("urls"), F.size(u).cast("int").alias("n_urls"))


_IP_RE_SQL = r"(?i)^https?://([^/?#]*@)?([0-9]{1,3}\.){3}[0-9]{1,3}(:[^/?#]*)?([/?#]|$)"


@register("h09_url_host_is_ip", f"WITH {EMAIL_VIEW}, u AS (SELECT doc_id, unnest(regexp_extract_all(body_text, 'https?://\\S+')) AS url FROM email) "
          f"SELECT doc_id, url, CAST(regexp_matches(url, '{_IP_RE_SQL}') AS INTEGER) AS is_ip FROM u")
def h09_url_host_is_ip(spark, sf):
    u = _ev(spark, sf).select("doc_id", F.explode(T.rule_urls("body_text")).alias("url"))
    return u.select("doc_id", "url", T.url_host_is_ip("url").cast("int").alias("is_ip"))


@register("h10_punycode_url", f"WITH {EMAIL_VIEW}, u AS (SELECT doc_id, regexp_extract_all(body_text, 'https?://\\S+') AS urls FROM email) "
          "SELECT doc_id, CAST(len(list_filter(urls, lambda x: contains(x, 'xn--'))) > 0 AS INTEGER) AS has_punycode FROM u")
def h10_punycode_url(spark, sf):
    return _ev(spark, sf).select("doc_id", T.any_punycode_url(T.rule_urls("body_text")).cast("int").alias("has_punycode"))


@register("h11_address_domain", f"WITH {EMAIL_VIEW} SELECT doc_id, {sql_domain('sender')} AS sender_domain, "
          f"{sql_domain('reply_to')} AS reply_domain, {sql_domain('return_path')} AS return_domain FROM email")
def h11_address_domain(spark, sf):
    return _ev(spark, sf).select("doc_id", S.domain_of("sender").alias("sender_domain"),
                                 S.domain_of("reply_to").alias("reply_domain"),
                                 S.domain_of("return_path").alias("return_domain"))


@register("h12_auth_results", f"WITH {EMAIL_VIEW} SELECT doc_id, {sql_auth('auth_results', 'spf')} AS spf_result, "
          f"{sql_auth('auth_results', 'dkim')} AS dkim_result, {sql_auth('auth_results', 'dmarc')} AS dmarc_result FROM email")
def h12_auth_results(spark, sf):
    v = _ev(spark, sf)
    return v.select("doc_id", *[S.auth_result("auth_results", m).alias(f"{m}_result") for m in S.AUTH_MECHANISMS])


@register("h13_received_ips", f"WITH {EMAIL_VIEW} SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS received_ips FROM "
          "(SELECT doc_id, list(ip ORDER BY pos) AS list_distinct_ordered FROM ("
          " SELECT doc_id, ip, min(pos) AS pos FROM (SELECT doc_id, unnest(regexp_extract_all(received, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b')) AS ip, "
          " generate_subscripts(regexp_extract_all(received, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'), 1) AS pos FROM email) GROUP BY doc_id, ip) GROUP BY doc_id)")
def h13_received_ips(spark, sf):
    return _ev(spark, sf).select("doc_id", F.array_join(S.received_ips("received"), ",").alias("received_ips"))


def _phrase_sql():
    from mailsieve.functions.constants import CREDENTIAL_PHRASES as CRED
    from mailsieve.functions.constants import MARKETING_PHRASES as MARKETING
    from mailsieve.functions.constants import URGENT_PHRASES as URGENT
    from mailsieve.plans.sqlviews import any_contains

    return (f"WITH {EMAIL_VIEW} SELECT doc_id, CAST({any_contains('lower(body_text)', URGENT)} AS INTEGER) AS urgent, "
            f"CAST({any_contains('lower(body_text)', CRED)} AS INTEGER) AS credential, "
            f"CAST({any_contains('lower(body_text)', MARKETING)} AS INTEGER) AS marketing FROM email")


@register("h14_phrase_lists", _phrase_sql())
def h14_phrase_lists(spark, sf):
    from mailsieve.functions import constants as K

    tl = F.lower("body_text")
    return _ev(spark, sf).select("doc_id", S.contains_any(tl, K.URGENT_PHRASES).cast("int").alias("urgent"),
                                 S.contains_any(tl, K.CREDENTIAL_PHRASES).cast("int").alias("credential"),
                                 S.contains_any(tl, K.MARKETING_PHRASES).cast("int").alias("marketing"))


@register("h15_excel_safe", "SELECT conv_id, turn, substr(s, 1, 1) AS first_char, sha256(s) AS safe_sha, "
          "CAST(length(s) AS BIGINT) AS safe_len FROM (SELECT conv_id, turn, "
          "CASE WHEN substr(v, 1, 1) IN ('=', '+', '-', '@') THEN '''' || v ELSE v END AS s FROM "
          "(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || text AS v "
          "FROM conversations))")
def h15_excel_safe(spark, sf):
    c = read_table(spark, sf, "conversations")
    lead = F.when(F.col("turn") % 4 == 0, "=").when(F.col("turn") % 4 == 1, "-").when(F.col("turn") % 4 == 2, "@").otherwise("")
    s = S.excel_safe(F.concat(lead, F.col("text")))
    return c.select("conv_id", "turn", F.substring(s, 1, 1).alias("first_char"), T.sha256_hex(s).alias("safe_sha"),
                    F.length(s).cast("long").alias("safe_len"))


# the header's form and zone vary with the event id; each form's offset in hours is added by the oracle
_DATE_FORMS = (("EEE, d MMM yyyy HH:mm:ss", " +0000", 0), ("EEE, dd MMM yyyy HH:mm:ss", " EST", 5), ("d MMM yyyy HH:mm:ss", " PDT", 7),
               ("EEE, d MMM yyyy HH:mm:ss", " GMT (Greenwich Mean Time)", 0), ("EEE, d MMM yy HH:mm:ss", " -0130 (x)", 1.5),
               ("EEE, d MMM yyyy HH:mm:ss", "", 0), ("d-MMM-yyyy HH:mm:ss", " +0530", -5.5), ("EEE, d MMM yyyy HH:mm:ss", " at dawn", None))


@register("h17_parse_rfc2822_date", "SELECT event_id, strftime(date_trunc('second', ts) + to_minutes(CASE event_id % 8 "
          + " ".join(f"WHEN {i} THEN {'NULL' if h is None else int(h * 60)}" for i, (_, _, h) in enumerate(_DATE_FORMS))
          + " END), '%Y-%m-%dT%H:%M:%S') AS parsed FROM events")
def h17_parse_rfc2822_date(spark, sf):
    e = read_table(spark, sf, "events")
    hdr = F.coalesce(*[F.when(F.col("event_id") % 8 == i, F.concat(F.date_format("ts", form), F.lit(zone)))
                       for i, (form, zone, _) in enumerate(_DATE_FORMS)])
    return e.select("event_id", F.date_format(S.parse_rfc2822(hdr), "yyyy-MM-dd'T'HH:mm:ss").alias("parsed"))


@register("h16_parse_ymd", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') "
          "END AS day FROM events")
def h16_parse_ymd(spark, sf):
    k = F.col("event_id") % 4
    given = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy-M-d"))
             .when(k == 2, F.date_format("ts", "yyyy-MM-dd'x'")).otherwise(F.date_format("ts", "'2_0'yy-MM-dd")))
    return read_table(spark, sf, "events").select("event_id", F.date_format(S.parse_ymd(given), "yyyy-MM-dd").alias("day"))


@register("h18_iso_timestamp", f"SELECT event_id, {sql_iso('ts')} AS iso FROM events")
def h18_iso_timestamp(spark, sf):
    return read_table(spark, sf, "events").select("event_id", S.iso_timestamp("ts").alias("iso"))


@register("h19_redact_dsn", "SELECT page_id, regexp_replace(dsn, '(://)([^:/@]+)(:([^@]*))?@', '\\1***:***@') AS redacted FROM "
          "(SELECT page_id, regexp_replace(url, '^(https?)://', '\\1://user' || CAST(page_id AS VARCHAR) || ':pw' || CAST(page_id % 7 AS VARCHAR) || '@') AS dsn FROM pages)")
def h19_redact_dsn(spark, sf):
    p = read_table(spark, sf, "pages")
    dsn = F.regexp_replace("url", "^(https?)://", F.concat(F.lit("$1://user"), F.col("page_id").cast("string"), F.lit(":pw"),
                                                           (F.col("page_id") % 7).cast("string"), F.lit("@")))
    return p.select("page_id", S.redact_dsn(dsn).alias("redacted"))


@register("g03_distinct_url_union", f"WITH {EMAIL_VIEW}, u AS (SELECT doc_id, list_sort(list_distinct(list_concat({sql_extract_urls('body_text')}, "
          "regexp_extract_all(body_text, 'https?://\\S+')))) AS urls FROM email) SELECT doc_id, array_to_string(urls, ' ') AS urls FROM u")
def g03_distinct_url_union(spark, sf):
    u = T.distinct_urls(T.extract_urls("body_text"), T.rule_urls("body_text"))
    return _ev(spark, sf).select("doc_id", F.array_join(u, " ").alias("urls"))


@register("b10_body_preview", f"WITH {EMAIL_VIEW} SELECT doc_id, substr(body_text, 1, 500) AS body_preview FROM email")
def b10_body_preview(spark, sf):
    return _ev(spark, sf).select("doc_id", T.preview("body_text").alias("body_preview"))
