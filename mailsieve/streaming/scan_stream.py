"""Continuous scanning of arriving mail (T1) with one stored e-mail per id.

``readStream`` (binaryFile for raw messages, or Parquet for a table of
texts) -> stateless parse/flag/rule columns -> ``foreachBatch``: each
micro-batch runs the batch scan (first-wins inside the batch, anti join
against the stored e-mails -- exact, no time horizon) and writes its outputs
to ``<table>/batch_id=<query id>-<epoch>`` with overwrite.  A replayed epoch rewrites
its own partition, and reads of the stored table exclude that partition, so
replays after an executor or driver loss give the same result; other streams
on the same table, or a stream that lost its checkpoint, never touch it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryManager

from mailsieve.operators.scans import scan_emails
from mailsieve.session import checkpoint_dir


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _stored(spark: SparkSession, path: str, batch_id: str) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("batch_id") != batch_id).drop("batch_id")


def make_batch_writer(streams: StreamingQueryManager, emails_path: str, scans_path: str, name: str, order: str = "doc_id", arrival: list[str] | None = None,
                      scorer=None, source: str = "stream", direction: str = "stream"):
    """``streams`` and ``name``: where the running query is found.  ``arrival``: columns that order a batch where there is no ``order`` column;
    scan ids then go on from the largest stored one (a micro-batch is bounded by its trigger, so it is ranked whole)."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # the id is kept in the stream's checkpoint: a new stream, or one that lost its checkpoint, has another
        (query,) = [q.id for q in streams.active if q.name == name]
        batch_id = f"{query}-{epoch}"
        if arrival:
            scans = _stored(spark, scans_path, batch_id)
            last = 0 if scans is None else scans.agg(F.max("id")).first()[0] or 0
            batch = batch.withColumn(order, F.row_number().over(Window.orderBy(*arrival)).cast("long") + F.lit(last) - 1)
        batch = batch.persist()
        try:
            scans, new = scan_emails(batch, scorer, _stored(spark, emails_path, batch_id), order=order, source=source,
                                     direction=direction, created_at=None)
            new.write.mode("overwrite").parquet(f"{emails_path}/batch_id={batch_id}")
            scans.write.mode("overwrite").parquet(f"{scans_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def start_mail_stream(spark: SparkSession, mail_dir: str, emails_path: str, scans_path: str, *,
                      checkpoint: str | None = None, scorer=None, available_now: bool = True,
                      max_files_per_trigger: int = 1000):
    """T1 over raw message files: binaryFile stream -> RFC-822 parse -> batch scan."""
    from mailsieve.sources.mail import parse_rfc822

    raw = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", max_files_per_trigger).load(mail_dir))
    parsed = parse_rfc822(raw)
    name = f"mail-{uuid.uuid4().hex}"
    ck = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/mail_stream"
    w = parsed.writeStream.queryName(name).foreachBatch(make_batch_writer(
        spark.streams, emails_path, scans_path, name, arrival=["path"], scorer=scorer)).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_view_stream(spark: SparkSession, sf_dir: str, emails_path: str, scans_path: str, *,
                      checkpoint: str | None = None, scorer=None, max_files_per_trigger: int = 1):
    """T1 over the supplied ``documents`` table read as a stream."""
    from mailsieve.operators.classify import parsed_from_view
    from mailsieve.sources import tables

    # the table is one file, or a folder of files; a glob path finds both
    table = f"{sf_dir.rstrip('/')}/documents*.parquet"
    docs = (spark.readStream.schema(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(table))
    view = parsed_from_view(tables.email_view_of(docs))
    name = f"view-{uuid.uuid4().hex}"
    ck = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/view_stream"
    return (view.writeStream.queryName(name).foreachBatch(make_batch_writer(spark.streams, emails_path, scans_path, name, scorer=scorer))
            .option("checkpointLocation", ck).trigger(availableNow=True).start())
