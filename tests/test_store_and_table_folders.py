"""Stored scans of few rows a day, and tables that are folders of files."""

import os

from pyspark.sql import functions as F

from mailsieve.operators.scan_store import ScanStore


def test_store_of_small_days_is_small(spark, tmpdir_path):
    days = spark.range(1, 31).select("id", F.format_string("e%d", "id").alias("email_id"), F.lit("safe").alias("label"),
                                     F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 86400).alias("created_at"))
    store = ScanStore(spark, f"{tmpdir_path}/store")
    store.append(days)
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{tmpdir_path}/store/rows") for f in names if f.endswith(".parquet")]
    # a bloom filter of the greatest size is 1 MB a column and file
    assert len(files) == 30 and sum(map(os.path.getsize, files)) < 30 * 20_000
    assert [r["id"] for r in store.lookup(12).collect()] == [12]


def test_view_stream_over_a_folder_of_files(spark, tmpdir_path):
    from mailsieve.streaming.scan_stream import start_view_stream

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"), F.lit("en").alias("lang"),
                                  F.lit("web").alias("source"), F.lit(6).cast("long").alias("n_chars"))
    docs.repartition(3).write.parquet(f"{tmpdir_path}/sf/documents.parquet")
    out = f"{tmpdir_path}/scans"
    start_view_stream(spark, f"{tmpdir_path}/sf", f"{tmpdir_path}/emails", out, checkpoint=f"{tmpdir_path}/offsets").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(1, 41))
