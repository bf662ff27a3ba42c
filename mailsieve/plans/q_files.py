"""Plans for the file-side operators and defaults, over paths and bytes derived from the tables (A2, A5, A7, A8, B13, B15,
G2, H26, H27, M7, M12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsieve.functions import text as T
from mailsieve.functions.constants import FOLDER_LABELS
from mailsieve.operators import corpus as C
from mailsieve.operators import scans as SC
from mailsieve.operators import train as TR
from mailsieve.plans.q_scans import _scans, scans_sql
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import CORPUS_VIEW, TRAIN_VIEW
from mailsieve.session import read_table
from mailsieve.sources import mail as ML
from mailsieve.sources.tables import corpus_view

# a mail tree in names: folder by doc_id, suffix by doc_id
FOLDERS = ("easy_ham", "spam", "hard_ham", "spam_2", "easy_ham_2", "unmapped")
SUFFIXES = (".eml", ".tar.gz", "", ".ZIP", ".xz.eml", ".7z", ".txt")
_FOLDER_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FOLDERS)) + " END"
_SUFFIX_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END"


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n).cast("int") + 1)


def _files(spark, sf):
    """(doc_id, path, length): one file name per document."""
    path = F.concat(F.lit("file:/data/mail.d/"), _pick(FOLDERS, 6), F.lit("/x/"), F.col("doc_id").cast("string"), _pick(SUFFIXES, 7))
    return read_table(spark, sf, "documents").select("doc_id", path.alias("path"), F.octet_length(F.col("text")).cast("long").alias("length"))


@register("a02_file_status", f"""SELECT doc_id, CASE WHEN doc_id % 7 IN (1, 3, 5) THEN 'archive'
  WHEN octet_length(encode(text)) > 3000 THEN 'oversize' ELSE 'candidate' END AS status FROM documents""")
def a02_file_status(spark, sf):
    """A2 + A3 over file names and sizes."""
    return ML.file_status(_files(spark, sf), 3000).select("doc_id", "status")


@register("a05_folder_label", f"""SELECT doc_id, CASE {_FOLDER_SQL} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FOLDER_LABELS.items())}
  END AS label FROM documents""")
def a05_folder_label(spark, sf):
    return _files(spark, sf).select("doc_id", ML.folder_label("path", "/data/mail.d").alias("label"))


@register("a07_relpath", f"SELECT doc_id, {_FOLDER_SQL} || '/x/' || CAST(doc_id AS VARCHAR) || {_SUFFIX_SQL} AS relpath FROM documents")
def a07_relpath(spark, sf):
    return _files(spark, sf).select("doc_id", ML.relpath("path", "/data/mail.d").alias("relpath"))


@register("a04_candidate_cap", f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 6
  ORDER BY 'file:/data/mail.d/' || {_FOLDER_SQL} || '/x/' || CAST(doc_id AS VARCHAR) || {_SUFFIX_SQL}) AS rn FROM documents) WHERE rn <= 20""")
def a04_candidate_cap(spark, sf):
    """A4: the first 20 paths of each folder (the cap is the feature), ranked on the listing alone."""
    return ML.cap_per_folder(_files(spark, sf), "/data/mail.d", 20).select("doc_id")


@register("a08_decode_utf8_ignore", r"""SELECT doc_id, sha256('a' || chr(10) || 'b' || chr(10) || regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') || 'z') AS text_sha
FROM documents""")
def a08_decode_utf8_ignore(spark, sf):
    """Bytes that are no UTF-8 are put around every text; CRLF and CR become LF."""
    raw = F.concat(F.unhex(F.lit("61FF0D0A62C30D")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("E282FE7A")))
    d = read_table(spark, sf, "documents").select("doc_id", raw.alias("content"))
    return d.select("doc_id", T.sha256_hex(T.decode_utf8_ignore(F.col("content"))).alias("text_sha"))


@register("b13_apply_defaults", scans_sql() + """ SELECT id, CASE WHEN id % 3 = 0 THEN 'safe' ELSE label END AS label,
  CASE WHEN id % 4 = 0 THEN 0.5 ELSE round(confidence, 6) END AS confidence, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS has_time FROM scans""")
def b13_apply_defaults(spark, sf):
    """Values taken out of the scans come back as the column defaults (a missing time as the time of the run)."""
    def hole(n, c):
        return F.when(F.col("id") % n != 0, F.col(c)).alias(c)

    s = _scans(spark, sf).select("id", hole(3, "label"), hole(4, "confidence"), hole(5, "created_at"), F.col("created_at").alias("given"))
    d = SC.apply_defaults(s)
    return d.select("id", "label", F.round("confidence", 6).alias("confidence"),
                    (F.col("created_at") == F.col("given")).cast("int").alias("has_time"))


@register("b15_tidy_columns", f"WITH {CORPUS_VIEW} SELECT sha256(coalesce(body_text, '')) AS body_text, label, source, relpath, len_chars FROM corpus")
def b15_tidy_columns(spark, sf):
    c = corpus_view(spark, sf).withColumn("body_text", T.sha256_hex(F.coalesce("body_text", F.lit("")))).withColumn("extra", F.lit(1))
    return C.tidy_columns(c)


@register("g02_union_of_trees", f"""SELECT label, count(*) AS n FROM (SELECT CASE {_FOLDER_SQL}
  {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FOLDER_LABELS.items())} END AS label FROM documents
  UNION ALL SELECT 'phishing' FROM pages) WHERE label IS NOT NULL GROUP BY label""")
def g02_union_of_trees(spark, sf):
    """A labelled tree and a tree of one label as one corpus; unmapped folders drop."""
    a = _files(spark, sf).select(ML.folder_label("path", "/data/mail.d").alias("label")).where("label IS NOT NULL")
    b = read_table(spark, sf, "pages").select(F.lit("phishing").alias("label"))
    return C.counts_per_label(C.union_corpora(a, b))


@register("h26_json_columns", scans_sql() + """ SELECT id, '{"urls_count":' || urls_count || ',"spf_fail":' || spf_fail || '}' AS header_flags
  FROM scans""")
def h26_json_columns(spark, sf):
    s = _scans(spark, sf).select("id", F.struct("header_flags.urls_count", "header_flags.spf_fail").alias("header_flags"))
    return SC.json_columns(s)


@register("h27_model_version", scans_sql() + " SELECT id, 'rules-7' AS model_version FROM scans")
def h27_model_version(spark, sf):
    from mailsieve.operators.classify import parsed_from_view
    from mailsieve.sources.tables import email_view

    scans, _ = SC.scan_emails(parsed_from_view(email_view(spark, sf)), model_version="rules-7")
    return scans.select("id", "model_version")


@register("m07_label_index", f"""WITH {CORPUS_VIEW}, {TRAIN_VIEW} SELECT doc_id, label,
  CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM train""")
def m07_label_index(spark, sf):
    t = C.training_rows(corpus_view(spark, sf)).select("doc_id", "label")
    return TR.with_label_index(t)


@register("m12_weighted_resample", f"""WITH RECURSIVE {CORPUS_VIEW}, {TRAIN_VIEW},
nn AS (SELECT count(*) AS n, count(*) + 6 * sqrt(count(*)) + 12 AS mean FROM train),
per AS (SELECT label, mean / ((SELECT count(DISTINCT label) FROM train) * count(*)) AS m FROM train, nn GROUP BY label, mean),
lam AS (SELECT label, CAST(ceil(m / 16) AS INTEGER) AS pieces, m / ceil(m / 16) AS l FROM per),
pk AS (SELECT label, l, 0 AS k, exp(-l) AS p, exp(-l) AS cdf FROM lam
  UNION ALL SELECT label, l, k + 1, p * l / (k + 1), cdf + p * l / (k + 1) FROM pk WHERE k < 60),
cdfs AS (SELECT label, list(cdf ORDER BY k) AS cdf FROM pk GROUP BY label),
u AS (SELECT doc_id, t.label AS label, piece, cdf,
    CAST('0x' || md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(piece AS VARCHAR))[1:13] AS BIGINT) / 4503599627370496.0 AS u
  FROM train t JOIN lam USING (label) JOIN cdfs USING (label), LATERAL (SELECT unnest(range(1, pieces + 1)) AS piece) x),
d AS (SELECT doc_id, label, CAST(doc_id AS VARCHAR) || ':' || CAST(piece AS VARCHAR) || ':' || CAST(i AS VARCHAR) AS draw
  FROM (SELECT doc_id, label, piece, unnest(range(1, len(list_filter(cdf, lambda c: c <= u)) + 1)) AS i FROM u)),
kept AS (SELECT doc_id, label FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || draw), draw) AS r FROM d), nn WHERE r <= n)
SELECT doc_id, label, count(*) AS copies FROM kept GROUP BY doc_id, label""")
def m12_weighted_resample(spark, sf):
    """How often every training row is drawn; rows that are not drawn have no row."""
    t = C.training_rows(corpus_view(spark, sf)).select("doc_id", "label").checkpoint()
    return TR.weighted_resample(t, "doc_id").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@register("m12_resample_shares", f"""WITH {CORPUS_VIEW}, {TRAIN_VIEW}, c AS (SELECT label, count(*) AS nc FROM train GROUP BY label)
SELECT label, (SELECT count(*) FROM train) AS n_drawn, TRUE AS total_as_expected, TRUE AS distinct_as_expected FROM c""")
def m12_resample_shares(spark, sf):
    """M12 against what drawing with replacement must give: a class's draws and its distinct rows, each within five standard deviations."""
    t = C.training_rows(corpus_view(spark, sf)).select("doc_id", "label").checkpoint()
    drawn = TR.weighted_resample(t, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("draws"), F.countDistinct("doc_id").alias("seen"))
    sizes = t.groupBy("label").agg(F.count(F.lit(1)).alias("nc"))
    every = Window.partitionBy()
    x = sizes.join(drawn, "label", "left").fillna(0).select(
        "*", F.sum("nc").over(every).alias("n"), F.count(F.lit(1)).over(every).alias("k"), F.sum("draws").over(every).alias("n_drawn"))
    mean = F.col("n") / F.col("k")
    missed = F.col("nc") * F.exp(-mean / F.col("nc"))  # rows that no draw hits
    return x.select("label", F.col("n_drawn"), (F.abs(F.col("draws") - mean) <= 5 * F.sqrt(mean) + 1).alias("total_as_expected"),
                    (F.abs(F.col("nc") - F.col("seen") - missed) <= 5 * F.sqrt(missed) + 1).alias("distinct_as_expected"))
