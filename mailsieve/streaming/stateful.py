"""Streams that keep their state in a state store.

``first_wins`` scans arriving mail with one e-mail per id: the state of an id (RocksDB) is the
scan of its first message, so later messages, in this or any later micro-batch, take that
result over and no stored e-mail is ever read.  First is the smallest arrival order of the
micro-batch in which an id comes up for the first time.

``windowed_counts`` counts scans per label and day of their event time.  The state of a day
is dropped once the watermark has passed its end; rows that come later still are not counted there.
``arrival_counts`` counts the same rows without state, as they arrive, so the difference of the two is what came late.

Scale: rules and flags are columns of the arriving rows; one shuffle by e-mail id (or by day and label, combined in the
tasks) a micro-batch.  A state holds a scan's result, never a body.  The rows of one id in one micro-batch are
held by a task (narrow but for their bodies, which only the first one keeps); a micro-batch is bounded by its trigger.
Sinks: a Parquet file sink with its own log for rows, a folder an epoch (overwritten on replay) for counts.

A null e-mail id cannot occur (it is a hash); null event times are counted under a null day
as they arrive and never in a window.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mailsieve.functions.text import preview
from mailsieve.operators.classify import with_header_flags
from mailsieve.operators.scans import reason_string, rules_scorer, with_email_id, with_parsed_defaults

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: for the counts, whose state is a row a label and open day
IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
#: what a later message of an id takes over from the first one
RESULT = ("subject", "sender", "body_preview", "label", "confidence", "reasons", "fallback_reason")
RESULT_SCHEMA = "subject string, sender string, body_preview string, label string, confidence double, reasons string, fallback_reason string"


#: off-heap memory that all state stores of an executor share
STORE_MB = 256


def use_state_store(spark: SparkSession, provider: str = ROCKSDB) -> None:
    """State of the streams started next: RocksDB is off the heap within STORE_MB an executor, with a changelog in the stream's checkpoint."""
    store = "spark.sql.streaming.stateStore"
    for key, value in ((f"{store}.providerClass", provider), (f"{store}.rocksdb.changelogCheckpointing.enabled", "true"),
                       (f"{store}.rocksdb.boundedMemoryUsage", "true"), (f"{store}.rocksdb.maxMemoryUsageMB", str(STORE_MB))):
        spark.conf.set(key, value)


class FirstWins(StatefulProcessor):
    """Per e-mail id: the first message's result, given to all of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", RESULT_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        new = None
        if self.first.exists():
            result = tuple(self.first.get())
        else:
            new = min(rows, key=lambda r: r["arrival"])
            result = tuple(new[c] for c in RESULT)
            self.first.update(result)
        for r in rows:
            yield Row(id=r["id"], email_id=key[0], **dict(zip(RESULT, result)), header_flags=r["header_flags"],
                      created_at=r["created_at"], new_email=r is new, body_text=r["body_text"] if r is new else None)

    def close(self) -> None:
        pass


def scored(parsed: DataFrame, order: str = "doc_id") -> DataFrame:
    """Every arriving message with its own rules result (columns RESULT), flags, id and body."""
    p = with_header_flags(with_email_id(with_parsed_defaults(parsed)))
    p = p.select((F.col(order) + 1).cast("long").alias("id"), F.col(order).cast("long").alias("arrival"), "email_id", "header_flags",
                 F.col("created_at").cast("timestamp").alias("created_at"), "subject", "sender", preview("body_text").alias("body_preview"),
                 "body_text", F.col("body_text").alias("body"))
    return rules_scorer(p).select(
        "id", "arrival", "email_id", "header_flags", "created_at", "subject", "sender", "body_preview", "label",
        F.col("confidence").cast("double").alias("confidence"), reason_string(F.col("reasons_list")).alias("reasons"),
        F.col("decision.fallback_reason").alias("fallback_reason"), F.col("body").alias("body_text"))


def first_wins(parsed: DataFrame, order: str = "doc_id") -> DataFrame:
    """Scans of a stream of parsed messages: one row a message, ``new_email`` and the body on the first of its id."""
    use_state_store(parsed.sparkSession)
    rows = scored(parsed, order)
    flags = rows.schema["header_flags"].dataType.simpleString()
    schema = f"id long, email_id string, {RESULT_SCHEMA}, header_flags {flags}, created_at timestamp, new_email boolean, body_text string"
    return rows.groupBy("email_id").transformWithState(FirstWins(), schema, "Append", "None")


def start_scans(parsed: DataFrame, path: str, checkpoint: str, order: str = "doc_id") -> StreamingQuery:
    """``first_wins`` into a Parquet table; all that has arrived is worked off."""
    out = first_wins(parsed, order).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(scans: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, label, n) per day of event time, updated as scans arrive; closed ``delay`` after the latest one seen."""
    timed = scans.withWatermark("created_at", delay)
    counted = timed.groupBy(F.window("created_at", "1 day").alias("w"), "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("w.start").alias("day"), "label", "n")


def arrival_counts(scans: DataFrame) -> DataFrame:
    """(day, label, n) of one micro-batch."""
    return scans.groupBy(F.to_date("created_at").alias("day"), "label").agg(F.count(F.lit(1)).alias("n"))


def start_counts(scans: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> list[StreamingQuery]:
    """Both counts of a stream of scans, into ``<path>/windows`` and ``<path>/arrivals``, one folder an epoch."""
    def writer(kind: str, narrow):
        def write(batch: DataFrame, epoch: int) -> None:
            narrow(batch).write.mode("overwrite").parquet(f"{path}/{kind}/epoch={epoch}")

        return write

    use_state_store(scans.sparkSession, IN_MEMORY)
    streams = ((windowed_counts(scans, delay), "windows", lambda b: b), (scans.select("created_at", "label"), "arrivals", arrival_counts))
    return [s.writeStream.outputMode("update" if kind == "windows" else "append").foreachBatch(writer(kind, narrow)).option(
        "checkpointLocation", f"{checkpoint}/{kind}").trigger(availableNow=True).start() for s, kind, narrow in streams]


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, label, n: counted in time, n_late): a day's count only grows, so its greatest is the last one."""
    schema = "day date, label string, n long, epoch long"
    windows, arrivals = (spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}") for kind in ("windows", "arrivals"))
    counted = windows.groupBy("day", "label").agg(F.max("n").alias("n"))
    came = arrivals.groupBy("day", "label").agg(F.sum("n").alias("came"))
    both = came.withColumnRenamed("day", "d").withColumnRenamed("label", "l")
    joined = both.join(counted, F.col("d").eqNullSafe(F.col("day")) & F.col("l").eqNullSafe(F.col("label")), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return joined.select(F.col("d").alias("day"), F.col("l").alias("label"), n.alias("n"), (F.col("came") - n).alias("n_late"))
