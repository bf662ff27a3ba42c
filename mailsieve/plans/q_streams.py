"""Plans of the streams that keep state (T2, X4): the ``documents`` table arrives in deliveries.

A delivery holds a range of ids; every tenth message (id % 10 = 3) comes one delivery late.
Each delivery is written to the arriving folder and worked off before the next one, so the
streams are stopped and started from their checkpoints in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailsieve.functions.signals import iso_timestamp
from mailsieve.operators.classify import parsed_from_view
from mailsieve.plans.q_scans import FLAG_COLS, scans_sql
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import sql_iso
from mailsieve.session import checkpoint_dir, read_table
from mailsieve.sources.tables import email_view_of
from mailsieve.streaming import stateful

RANGES = 4


def _deliveries(docs):
    """``documents`` with the number of the delivery that a row comes in."""
    last = docs.agg(F.max("doc_id").alias("last")).scalar()
    own = F.floor(F.col("doc_id") * RANGES / (last + 1))
    return docs.withColumn("delivery", (own + F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0)).cast("int"))


def _delivered(spark, sf, work):
    """Call ``work(arrived schema, folder)`` after every delivery."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    docs = read_table(spark, sf, "documents")
    numbered = _deliveries(docs)
    for k in range(RANGES + 1):
        numbered.where(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{folder}/in")
        work(spark.readStream.schema(docs.schema).parquet(f"{folder}/in"), folder)
    return folder


def _scan_arrivals(docs, folder):
    stateful.start_scans(parsed_from_view(email_view_of(docs)), f"{folder}/scans", f"{folder}/offsets").awaitTermination()


@register("t02_stream_state", scans_sql() + f""" SELECT id, email_id, subject, sender, label, round(confidence, 6) AS confidence, reasons,
  {FLAG_COLS}, {sql_iso('created_at')} AS created_at, id = min(id) OVER (PARTITION BY email_id) AS new_email,
  CASE WHEN id = min(id) OVER (PARTITION BY email_id) THEN (SELECT sha256(body_text) FROM p0 WHERE p0.doc_id = id - 1) END AS body_sha FROM scans""")
def t02_stream_state(spark, sf):
    """Five deliveries, one e-mail per id by keyed state; equal to the batch scan of the whole table."""
    folder = _delivered(spark, sf, _scan_arrivals)
    return spark.read.parquet(f"{folder}/scans").select(
        "id", "email_id", "subject", "sender", "label", F.round("confidence", 6).alias("confidence"), "reasons", "header_flags.*",
        iso_timestamp("created_at").alias("created_at"), "new_email", F.when(F.col("new_email"), F.sha2("body_text", 256)).alias("body_sha"))


_COUNTS_SQL = scans_sql() + f""", lastid AS (SELECT max(doc_id) AS m FROM documents),
arrived AS (SELECT s.label AS label, s.created_at AS ts, CAST(s.created_at AS DATE) AS day,
  CAST(floor((s.id - 1) * {RANGES} / (m + 1)) AS INTEGER) + CASE WHEN (s.id - 1) % 10 = 3 THEN 1 ELSE 0 END AS k FROM scans s, lastid),
marks AS (SELECT k, max(max(ts)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM arrived GROUP BY k),
judged AS (SELECT a.*, coalesce(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= mark, FALSE) AS late FROM arrived a JOIN marks USING (k))
SELECT CAST(day AS VARCHAR) AS day, label, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS n_late FROM judged GROUP BY day, label"""


@register("x04_stream_counts", _COUNTS_SQL)
def x04_stream_counts(spark, sf):
    """The scans that T2 writes, counted per day of event time with a watermark of one day; late rows apart."""
    def work(docs, folder):
        _scan_arrivals(docs, folder)
        scans = spark.readStream.schema(spark.read.parquet(f"{folder}/scans").schema).parquet(f"{folder}/scans")
        for query in stateful.start_counts(scans.select("created_at", "label"), f"{folder}/counts", f"{folder}/counted"):
            query.awaitTermination()

    folder = _delivered(spark, sf, work)
    return stateful.read_counts(spark, f"{folder}/counts").select(F.col("day").cast("string").alias("day"), "label", "n", "n_late")
