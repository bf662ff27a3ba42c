"""SQL text of the derived views, for the DuckDB oracle.

These restate ``mailsieve.sources.tables`` in plain SQL; queries prepend them
as CTEs.  RE2 (DuckDB) treats ``\\s`` as ASCII, which is exact on the supplied
tables (they hold no non-ASCII whitespace).
"""

from mailsieve.functions.constants import CREDENTIAL_PHRASES, MARKETING_PHRASES, URGENT_PHRASES

EMAIL_VIEW = r"""
email AS (
SELECT d.doc_id,
  CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE '<' || CAST(d.doc_id AS VARCHAR) || '@mx.example.com>' END AS message_id,
  'Subject ' || CAST(d.doc_id % 4 AS VARCHAR) AS subject,
  'user' || CAST(d.doc_id % 5 AS VARCHAR) || '@Host' || CAST(d.doc_id % 3 AS VARCHAR) || '.example.com' AS sender,
  CASE d.doc_id % 3 WHEN 0 THEN 'help@other.example.net' WHEN 1 THEN 'x@host1.example.com' ELSE '' END AS reply_to,
  CASE d.doc_id % 4 WHEN 0 THEN '<b@bounce.example.org>' ELSE '' END AS return_path,
  CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'mx; spf=pass; dkim=pass; dmarc=pass'
       WHEN 2 THEN 'mx; spf=fail smtp.mailfrom=a; dkim=pass' ELSE 'mx; SPF=SoftFail; DKIM = fail; dmarc=FAIL; spf=pass' END AS auth_results,
  'from a (1.2.3.' || CAST(d.doc_id % 250 AS VARCHAR) || ') by b; from c (10.0.0.' || CAST(d.doc_id % 3 AS VARCHAR)
    || ') by d (1.2.3.' || CAST(d.doc_id % 250 AS VARCHAR) || ')' AS received,
  '' AS date_hdr,
  d.text || ' ' || CASE d.doc_id % 8
    WHEN 0 THEN '' WHEN 1 THEN 'Urgent: login now' WHEN 2 THEN 'See http://192.168.10.5/login immediately'
    WHEN 3 THEN 'Special offer, act now' WHEN 4 THEN 'Visit https://xn--pple-43d.com/ for details'
    WHEN 5 THEN 'Limited time: unsubscribe at https://xn--80ak6aa92e.com'
    WHEN 6 THEN 'Final notice http://10.0.0.1 https://xn--a.com update your password'
    ELSE 'Notes at HTTPS://example.org/a, and (http://example.com/b).' END AS body_text,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN ' Phish ' WHEN l.quality = 0 THEN 'SPAM' ELSE 'ham' END AS raw_label,
  d.source,
  TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' HOUR AS created_at,
  ((d.doc_id * 37) % 101) / CAST(100 AS DOUBLE) AS p_pos
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

# Rule signals (M1) per e-mail, as SQL over ``email``.
IP_RE = r"(?i)^https?://([^/?#]*@)?([0-9]{1,3}\.){3}[0-9]{1,3}(:[^/?#]*)?([/?#]|$)"


def any_contains(col: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in phrases) + ")"


def rules_cte(src: str = "email", text: str = "body_text", key: str = "doc_id") -> str:
    """CTEs ``rsig`` and ``rule`` (columns key, label, confidence, score, reasons)."""
    return rf"""
rsig AS (
  SELECT {key} AS k, coalesce({text}, '') AS t, lower(coalesce({text}, '')) AS tl,
         regexp_extract_all(coalesce({text}, ''), 'https?://\S+') AS urls
  FROM {src}
), rflag AS (
  SELECT k,
    {any_contains('tl', URGENT_PHRASES)} AS urgent,
    len(list_filter(urls, lambda u: regexp_matches(u, '{IP_RE}'))) > 0 AS ip,
    len(list_filter(urls, lambda u: contains(u, 'xn--'))) > 0 AS puny,
    {any_contains('tl', CREDENTIAL_PHRASES)} AS cred,
    {any_contains('tl', MARKETING_PHRASES)} AS spammy,
    len(urls) > 0 AS any_url
  FROM rsig
), rscore AS (
  SELECT *, CAST(0.0 AS DOUBLE)
     + CASE WHEN urgent THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
     + CASE WHEN ip THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
     + CASE WHEN puny THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
     + CASE WHEN cred THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score
  FROM rflag
), rule AS (
  SELECT k AS {key},
    CASE WHEN score >= CAST(0.6 AS DOUBLE) THEN 'phishing' WHEN spammy THEN 'spam' ELSE 'safe' END AS label,
    CASE WHEN score >= CAST(0.6 AS DOUBLE) THEN least(CAST(0.99 AS DOUBLE), CAST(0.5 AS DOUBLE) + score / CAST(2.0 AS DOUBLE))
         WHEN spammy THEN CAST(0.6 AS DOUBLE)
         WHEN urgent OR cred OR any_url THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS confidence,
    score,
    concat_ws(', ',
      CASE WHEN urgent THEN 'urgent language' END,
      CASE WHEN ip THEN 'url uses raw ip' END,
      CASE WHEN puny THEN 'punycode url' END,
      CASE WHEN cred THEN 'credential lure' END,
      CASE WHEN spammy AND score < CAST(0.5 AS DOUBLE) THEN 'marketing language' END) AS reasons
  FROM rscore
)"""


URL_RE = "(?i)https?://[^\\s)>\\]\"']+"
URL_TRAIL = "[).,>\\]}\"']+$"


def sql_extract_urls(col: str) -> str:
    """H7 in DuckDB (list of trimmed URLs)."""
    return (f"list_transform(regexp_extract_all(coalesce({col}, ''), '{URL_RE.replace(chr(39), chr(39) * 2)}'), "
            f"lambda u: regexp_replace(u, '{URL_TRAIL.replace(chr(39), chr(39) * 2)}', ''))")


def sql_domain(col: str) -> str:
    return f"lower(regexp_extract(coalesce({col}, ''), '@([A-Za-z0-9.-]+)', 1))"


def sql_auth(col: str, mech: str) -> str:
    return f"lower(nullif(regexp_extract(coalesce({col}, ''), '(?i){mech}\\s*=\\s*([a-z]+)', 1), ''))"


def sql_short_id(*cols: str) -> str:
    parts = " || ".join(f"coalesce({c}, '') || chr(0)" for c in cols)
    return f"substr(sha256({parts}), 1, 16)"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def sql_normalize(expr: str, lower: bool = True) -> str:
    e = f"lower(coalesce({expr}, ''))" if lower else f"coalesce({expr}, '')"
    return sql_strip(f"regexp_replace({e}, '\\s+', ' ', 'g')")


def sql_iso(ts: str) -> str:
    return (f"coalesce(CASE WHEN strftime({ts}, '%f') = '000000' THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END, '')")

CORPUS_VIEW = r"""
corpus AS (
SELECT d.doc_id, d.text AS body_text,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN ' Phish ' WHEN l.quality = 0 THEN 'SPAM' ELSE 'ham' END AS label,
  d.source, d.source || '/' || CAST(d.doc_id AS VARCHAR) AS relpath, CAST(length(d.text) AS INTEGER) AS len_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def sql_canonical(col: str) -> str:
    k = f"lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'))"
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE CASE {k} WHEN 'ham' THEN 'safe' WHEN 'ok' THEN 'safe' "
            f"WHEN 'legit' THEN 'safe' WHEN 'safe' THEN 'safe' WHEN 'spam' THEN 'spam' WHEN 'phish' THEN 'phishing' "
            f"WHEN 'phishing' THEN 'phishing' WHEN 'fraud' THEN 'phishing' ELSE {k} END END")


TRAIN_VIEW = r"""
train AS (
SELECT doc_id, regexp_replace(body_text, '^\s+|\s+$', '', 'g') AS body_text, canon AS label, source
FROM (SELECT *, """ + sql_canonical("label") + r""" AS canon FROM corpus)
WHERE body_text IS NOT NULL AND regexp_replace(body_text, '^\s+|\s+$', '', 'g') <> ''
  AND canon IN ('phishing', 'safe', 'spam')
)"""
