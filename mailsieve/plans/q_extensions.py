"""Plans for the documented-but-unbuilt extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions import text as T
from mailsieve.operators import metrics as M
from mailsieve.operators import scans as SC
from mailsieve.operators.score import priority_decision
from mailsieve.plans.q_metrics import EVAL_SQL, _SOFTMAX_SQL, THRESHOLDS, eval_view
from mailsieve.plans.q_scans import _scans, scans_sql
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import CORPUS_VIEW, EMAIL_VIEW, TRAIN_VIEW, sql_canonical, sql_normalize
from mailsieve.sources.tables import corpus_view, email_view, labelled_email_view

RETENTION_CUTOFF = "2024-01-20 00:00:00"
MIX_TARGET = 100_000


@register("x01_balanced_mix", f"""WITH {CORPUS_VIEW}, {TRAIN_VIEW}, r AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM train)
SELECT doc_id, label, greatest({MIX_TARGET} - n, 0) AS shortfall FROM r WHERE rn <= {MIX_TARGET}""")
def x01_balanced_mix(spark, sf):
    from mailsieve.operators.corpus import training_rows

    t = training_rows(corpus_view(spark, sf)).select("doc_id", "label")
    return M.balanced_mix(t, "doc_id", "label", MIX_TARGET, 42).select("doc_id", "label", F.col("shortfall").cast("long").alias("shortfall"))


@register("x03_retention_blank_bodies", f"""WITH {EMAIL_VIEW} SELECT doc_id,
  CASE WHEN created_at < TIMESTAMP '{RETENTION_CUTOFF}' THEN NULL ELSE sha256(body_text) END AS body_sha FROM email""")
def x03_retention_blank_bodies(spark, sf):
    v = email_view(spark, sf)
    kept = F.when(F.col("created_at") < F.lit(RETENTION_CUTOFF).cast("timestamp"), F.lit(None).cast("string")) \
        .otherwise(F.col("body_text"))
    return v.select("doc_id", T.sha256_hex(kept).alias("body_sha"))


_CORR_SQL = scans_sql() + f""", corr AS (
  SELECT doc_id + 1 AS scan_id, 'safe' AS new_label, created_at + INTERVAL 1 HOUR AS at_ts FROM email WHERE raw_label IS NOT NULL
  UNION ALL
  SELECT doc_id + 1, {sql_canonical('raw_label')}, created_at + INTERVAL 2 HOUR FROM email WHERE raw_label IS NOT NULL),
latest AS (SELECT scan_id, arg_max(new_label, at_ts) AS new_label FROM corr GROUP BY scan_id)
SELECT s.id, s.label AS predicted, coalesce(l.new_label, s.label) AS label FROM scans s LEFT JOIN latest l ON l.scan_id = s.id"""


@register("x05_label_corrections", _CORR_SQL)
def x05_label_corrections(spark, sf):
    from mailsieve.operators.corpus import canonical_label

    v = labelled_email_view(spark, sf).where(F.col("raw_label").isNotNull())
    corr = v.select((F.col("doc_id") + 1).alias("scan_id"), F.lit("safe").alias("new_label"),
                    (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("at")).unionByName(
        v.select((F.col("doc_id") + 1).alias("scan_id"), canonical_label("raw_label").alias("new_label"),
                 (F.col("created_at") + F.expr("INTERVAL 2 HOUR")).alias("at")))
    return SC.apply_corrections(_scans(spark, sf), corr).select("id", "predicted", "label")


@register("x06_priority_policy", EVAL_SQL + _SOFTMAX_SQL + """ SELECT doc_id, CASE WHEN p[1] >= 0.72 THEN 'phishing'
  WHEN p[3] >= 0.91 THEN 'spam' ELSE 'safe' END AS label FROM pr3""")
def x06_priority_policy(spark, sf):
    e = eval_view(spark, sf).withColumn("probs", M.softmax(F.col("logits")))
    return e.select("doc_id", priority_decision(F.col("probs"), ("phishing", "safe", "spam"), THRESHOLDS).alias("label"))


@register("x07_history_filters", scans_sql() + """ SELECT id, label FROM scans
  WHERE lower(regexp_extract(sender, '@([A-Za-z0-9.-]+)', 1)) = 'host1.example.com' AND label = 'phishing'
    AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-25' + INTERVAL 1 DAY""")
def x07_history_filters(spark, sf):
    s = SC.filter_scans(_scans(spark, sf), label="phishing", date_from="2024-01-05", date_to="2024-01-25",
                        sender_domain="host1.example.com")
    return s.select("id", "label")

def _x02_sql() -> str:
    """X2 restated: sets, signatures and bands; in every band the smallest document left is compared with the others."""
    from mailsieve.operators.neardup import PRIME, SHINGLE, THRESHOLD, factors

    bands, rows = 16, 4
    pairs = factors(bands * rows)
    minima = ", ".join(f"list_min(list_transform(hs, lambda h: ({a}::BIGINT * (h % {PRIME}) + {b}) % {PRIME}))" for a, b in pairs)
    keys = ", ".join("concat_ws('_', {}, {})".format(b, ", ".join(f"sig[{b * rows + r + 1}]" for r in range(rows))) for b in range(bands))
    return f"""WITH RECURSIVE {CORPUS_VIEW},
w AS (SELECT doc_id, string_split({sql_normalize("coalesce(body_text, '')")}, ' ') AS w FROM corpus),
s AS (SELECT doc_id, list_distinct(list_transform(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2),
  lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) ELSE w END, lambda x: CAST('0x' || md5(x)[1:15] AS BIGINT))) AS hs FROM w),
sg AS (SELECT doc_id, [{minima}] AS sig FROM s),
bd AS (SELECT doc_id, unnest([{keys}]) AS band FROM sg),
many AS (SELECT * FROM bd WHERE band IN (SELECT band FROM bd GROUP BY band HAVING count(*) > 1)),
jac AS MATERIALIZED (SELECT p.a AS a, p.b AS b, len(list_intersect(x.hs, y.hs)) / (len(x.hs) + len(y.hs) - len(list_intersect(x.hs, y.hs))) AS j
  FROM (SELECT DISTINCT m.doc_id AS a, n.doc_id AS b FROM many m JOIN many n ON m.band = n.band AND m.doc_id < n.doc_id) p
  JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b),
rest AS (SELECT band, doc_id FROM many
  UNION ALL SELECT r.band, r.doc_id FROM (SELECT band, doc_id, min(doc_id) OVER (PARTITION BY band) AS first FROM rest) r
    JOIN jac ON a = first AND b = doc_id WHERE j < {THRESHOLD}),
firsts AS (SELECT band, doc_id, count(*) AS turns FROM rest GROUP BY band, doc_id),
links AS (SELECT DISTINCT first AS a, doc_id AS b FROM (
    SELECT x.band, x.doc_id, y.doc_id AS first FROM firsts x JOIN firsts y ON x.band = y.band AND y.doc_id < x.doc_id
    WHERE y.turns <= x.turns AND NOT EXISTS (SELECT 1 FROM firsts z WHERE z.band = x.band AND z.turns >= y.turns AND z.doc_id < y.doc_id)) q
  JOIN jac ON jac.a = q.first AND jac.b = q.doc_id WHERE j >= {THRESHOLD}),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc, a AS root FROM both_ways UNION SELECT t.b, r.root FROM reach r JOIN both_ways t ON t.a = r.doc)
SELECT doc_id FROM corpus WHERE doc_id NOT IN (SELECT doc FROM reach GROUP BY doc HAVING min(root) < doc)"""


@register("x02_near_duplicates", _x02_sql())
def x02_near_duplicates(spark, sf):
    """Documents kept after near-duplicate removal (MinHash bands, exact Jaccard, components)."""
    from mailsieve.operators.neardup import drop_near_duplicates

    kept = drop_near_duplicates(corpus_view(spark, sf).select("doc_id", "body_text"))
    return kept.select("doc_id")


@register("x02_band_clusters", """WITH RECURSIVE lines AS (SELECT DISTINCT doc_id, md5(line) AS band
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 100),
first AS (SELECT band, min(doc_id) AS f FROM lines GROUP BY band),
e AS (SELECT DISTINCT f AS a, doc_id AS b FROM lines JOIN first USING (band) WHERE f <> doc_id),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT doc_id AS doc, doc_id AS root FROM lines UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.doc)
SELECT doc AS doc_id, min(root) AS cluster FROM reach GROUP BY doc""")
def x02_band_clusters(spark, sf):
    """X2's clustering with long lines as bands, which both engines hash alike."""
    from mailsieve.operators.neardup import clusters_of_bands
    from mailsieve.session import checkpoint_dir, read_table

    checkpoint_dir(spark)
    line = read_table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    banded = line.where(F.length("line") >= 100).select("doc_id", F.md5("line").alias("band")).distinct()
    return clusters_of_bands(banded.checkpoint())
