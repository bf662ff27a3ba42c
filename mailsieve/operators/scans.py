"""Scan pipeline and scan-table queries.

Design notes for scale
* E-mail ids are content hashes; one id may repeat across a large part of a
  batch (pasted texts with one subject/sender).  First-wins is a hash aggregate
  of the smallest order per id on narrow rows; the payload follows by a join on (id,
  order), so the rows of a hot id are spread over all tasks.
* Rules are evaluated once per surviving e-mail, then joined back to the scan
  rows on ``email_id``.  The survivors are partitioned by (id, order), so this
  join shuffles both sides and AQE can split a hot id on the scan side.
* Nothing is collected; appends are plain DataFrame writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.signals import excel_safe, iso_timestamp, parse_rfc2822, parse_ymd, reason_string, recipients, token_reason_string
from mailsieve.functions.text import preview, short_id
from mailsieve.operators.corpus import first_per_key
from mailsieve.operators.classify import parsed_from_view, with_header_flags, with_rules

EMAIL_COLUMNS = (
    "id", "source", "message_id", "subject", "sender", "recipients", "reply_to", "return_path", "timestamp",
    "body_text", "html_raw", "has_text", "has_html", "urls", "attachments", "attachments_count",
    "list_unsubscribe", "spf_result", "dkim_result", "dmarc_result", "received_ips",
)
SCAN_COLUMNS = (
    "id", "email_id", "subject", "sender", "body_preview", "label", "confidence", "reasons", "header_flags",
    "probs", "details", "model_version", "direction", "created_at",
)


def _col_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def with_email_id(df: DataFrame) -> DataFrame:
    """H4: e-mail id from (message_id, subject, raw Date header, sender)."""
    return df.withColumn("email_id", short_id(_col_or(df, "message_id", F.lit("")), _col_or(df, "subject", F.lit("")),
                                              _col_or(df, "date_hdr", F.lit("")), _col_or(df, "sender", F.lit(""))))


def email_rows(parsed: DataFrame, source: str = "upload", *extra: Column) -> DataFrame:
    """EMAILS projection of parsed messages (one row per input row, keyed by ``email_id``)."""
    p = parsed
    arr = F.array().cast("array<string>")
    return p.select(
        *extra,
        F.col("email_id").alias("id"),
        F.lit(source).alias("source"),
        _col_or(p, "message_id", F.lit("")).alias("message_id"),
        _col_or(p, "subject", F.lit("")).alias("subject"),
        _col_or(p, "sender", F.lit("")).alias("sender"),
        recipients(_col_or(p, "to", F.lit("")), _col_or(p, "cc", F.lit("")), _col_or(p, "bcc", F.lit(""))).alias("recipients"),
        _col_or(p, "reply_to", F.lit("")).alias("reply_to"),
        _col_or(p, "return_path", F.lit("")).alias("return_path"),
        parse_rfc2822(_col_or(p, "date_hdr", F.lit(""))).alias("timestamp"),
        F.col("body_text"),
        _col_or(p, "html_raw", F.lit("")).alias("html_raw"),
        _col_or(p, "has_text", F.lit(0)).cast("int").alias("has_text"),
        _col_or(p, "has_html", F.lit(0)).cast("int").alias("has_html"),
        _col_or(p, "urls", arr).alias("urls"),
        _col_or(p, "attachments", arr).alias("attachments"),
        _col_or(p, "attachments_count", F.lit(0)).cast("int").alias("attachments_count"),
        _col_or(p, "list_unsubscribe", F.lit("")).alias("list_unsubscribe"),
        _col_or(p, "spf_result", F.lit(None).cast("string")).alias("spf_result"),
        _col_or(p, "dkim_result", F.lit(None).cast("string")).alias("dkim_result"),
        _col_or(p, "dmarc_result", F.lit(None).cast("string")).alias("dmarc_result"),
        _col_or(p, "received_ips", arr).alias("received_ips"),
    )


def with_parsed_defaults(df: DataFrame) -> DataFrame:
    """Text-only requests carry no headers: blank strings, no URLs, null auth results,
    ``has_text`` = body non-empty."""
    arr = F.array().cast("array<string>")
    defaults = {
        "message_id": F.lit(""), "subject": F.lit(""), "sender": F.lit(""), "reply_to": F.lit(""),
        "return_path": F.lit(""), "date_hdr": F.lit(""), "urls": arr, "received_ips": arr,
        "spf_result": F.lit(None).cast("string"), "dkim_result": F.lit(None).cast("string"),
        "dmarc_result": F.lit(None).cast("string"), "has_html": F.lit(0),
        "has_text": (F.coalesce(F.col("body_text"), F.lit("")) != "").cast("int"),
    }
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def insert_if_absent(batch_emails: DataFrame, existing: DataFrame | None, order: str = "__ord") -> tuple[DataFrame, DataFrame]:
    """Returns (new_emails, current_emails_for_batch).

    ``batch_emails`` has one row per scan with column ``id`` and the arrival
    order ``order``.  First-wins inside the batch, then an anti join against
    the stored table.  ``current`` is one row per id touched by the batch:
    the stored row when it exists, else the batch survivor (Q7 behaviour).
    """
    survivors = first_per_key(batch_emails, ["id"], order).drop(order)
    if existing is None:
        return survivors, survivors
    ex = existing.select(*survivors.columns)
    new = survivors.join(ex.select("id"), "id", "left_anti")
    touched = ex.join(survivors.select("id"), "id", "left_semi")
    return new, touched.unionByName(new)


def cascade_delete(scans: DataFrame, deleted_email_ids: DataFrame) -> DataFrame:
    """C4: scans left after deleting e-mails; scans with a null FK stay."""
    return scans.join(deleted_email_ids.select(F.col("id").alias("email_id")), "email_id", "left_anti")


def rules_scorer(emails: DataFrame) -> DataFrame:
    """Default scorer: (email_id, body_text, ...) -> label, confidence, reasons_list, decision, probs (M1 + M17).

    A pure projection: every input column except ``body_text`` is passed through.
    """
    r = F.col("rule")
    keep = [c for c in emails.columns if c != "body_text"]
    return with_rules(emails, "body_text").select(
        *keep,
        r["label"].alias("label"),
        r["confidence"].alias("confidence"),
        r["reasons"].alias("reasons_list"),
        F.struct(
            F.struct(r["label"].alias("label"), r["confidence"].alias("prob")).alias("raw_top"),
            F.lit(None).cast("map<string,double>").alias("thresholds_used"),
            F.lit(None).cast("struct<label:string,prob:double>").alias("winner"),
            F.lit("heuristics_only").alias("fallback_reason"),
        ).alias("decision"),
        F.lit(None).cast("map<string,double>").alias("probs"),
    )


def scan_emails(parsed: DataFrame, scorer=None, existing_emails: DataFrame | None = None, *,
                order: str = "doc_id", scan_id: str | None = None, source: str = "upload",
                direction: str = "upload", model_version: str | None = None,
                created_at: str | None = "created_at") -> tuple[DataFrame, DataFrame]:
    """M5: batch scan.  Returns (scans, new_emails).

    ``parsed`` carries the PARSED columns (see ``classify.parsed_from_view``)
    and an arrival-order column ``order``.  Header flags come from each row's
    own parse; the scored body, subject and sender from the surviving e-mail.
    """
    scorer = scorer or rules_scorer
    p = with_header_flags(with_email_id(with_parsed_defaults(parsed)))
    emails = email_rows(p, source, F.col(order).alias("__ord"))
    new_emails, current = insert_if_absent(emails, existing_emails, "__ord")
    shown = ["subject", "sender"]
    if scorer is rules_scorer and existing_emails is None:
        # every row is scored where it is read; what is shuffled is the first one's result, not its body
        scored = rules_scorer(p.select(F.col(order).alias("__ord"), "email_id", "body_text", *[F.col(c).alias(f"e_{c}") for c in shown],
                                       preview("body_text").alias("body_preview")))
        result = F.struct(*[c for c in scored.columns if c not in ("__ord", "email_id")])
        per_email = scored.groupBy("email_id").agg(F.min_by(result, "__ord").alias("r")).select("email_id", "r.*")
    else:
        em = current.select(F.col("id").alias("email_id"), "body_text", *[F.col(c).alias(f"e_{c}") for c in shown],
                            preview("body_text").alias("body_preview"))
        # the rules are a projection over the survivors: no join back to the same aggregate
        per_email = rules_scorer(em) if scorer is rules_scorer else em.drop("body_text").join(
            scorer(em.select("email_id", "body_text")), "email_id")
    reasons_list = F.col("reasons_list")
    scans = p.select(
        (F.col(scan_id) if scan_id else F.col(order) + 1).cast("long").alias("id"),
        "email_id", "header_flags",
        (F.col(created_at) if created_at and created_at in p.columns else F.current_timestamp()).alias("created_at"),
    ).join(per_email, "email_id").select(
        "id", "email_id",
        F.col("e_subject").alias("subject"),
        F.col("e_sender").alias("sender"),
        "body_preview", "label",
        F.col("confidence").cast("double").alias("confidence"),
        (reason_string if scorer is rules_scorer else token_reason_string)(reasons_list).alias("reasons"),
        "header_flags", "probs",
        F.struct(F.col("decision.raw_top").alias("raw_top"), F.col("decision.thresholds_used").alias("thresholds_used"),
                 F.col("decision.winner").alias("winner"), F.col("decision.fallback_reason").alias("fallback_reason"),
                 reasons_list.alias("reasons")).alias("details"),
        F.lit(model_version).cast("string").alias("model_version"),
        F.lit(direction).alias("direction"),
        "created_at",
    )
    return scans, new_emails


def scan_view(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rules-only scans of the derived e-mail view (scan id = doc_id + 1)."""
    from mailsieve.sources.tables import email_view

    return scan_emails(parsed_from_view(email_view(spark, sf_dir)))


# --- scan-table queries ------------------------------------------------------

def page_of(scans: DataFrame, page: int = 1, page_size: int = 10, total: int | None = None) -> tuple[DataFrame, dict]:
    """newest-first page.  ``total`` may be passed in to skip the count job."""
    if not 1 <= page_size <= 100:
        raise ValueError("page_size must be in 1..100")
    if page < 1:
        raise ValueError("page must be >= 1")
    n = scans.count() if total is None else total
    pages = max(1, (n + page_size - 1) // page_size)
    page = min(page, pages)
    rows = scans.orderBy(F.desc("id")).offset((page - 1) * page_size).limit(page_size)
    return rows, {"total": n, "page": page, "pages": pages, "page_size": page_size}


def page_by_rank(scans: DataFrame, page: int, page_size: int) -> DataFrame:
    """F1 without a count action: the clamp to the last page is a scalar subquery.

    A top-(page*size) sort is a bounded TakeOrdered per task; the page is then
    cut from that bounded set, never from a global window over the table.
    """
    n = scans.agg(F.count(F.lit(1)).alias("n"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(page_size))).cast("long")
    eff = n.select(F.least(F.lit(page), pages).alias("page")).scalar()
    top = scans.orderBy(F.desc("id")).limit(page * page_size)
    ranked = top.withColumn("__rn", F.row_number().over(Window.orderBy(F.desc("id"))))
    return ranked.where((F.col("__rn") > (eff - 1) * page_size) & (F.col("__rn") <= eff * page_size)).drop("__rn")


def _day(value: str) -> Column:
    """H16 of a filter value, checked when the plan is built."""
    from datetime import datetime

    try:
        if not value.replace("-", "").isdecimal():
            raise ValueError(value)
        datetime.strptime(value, "%Y-%m-%d")
    except ValueError as e:
        raise ValueError(f"Invalid date format '{value}'. Use YYYY-MM-DD.") from e
    return parse_ymd(F.lit(value))


def filter_scans(scans: DataFrame, label: str | None = None, date_from: str | None = None,
                 date_to: str | None = None, sender_domain: str | None = None) -> DataFrame:
    """B7 + B8 (+ X7 sender domain): label equality, inclusive date range (end of day
    through the next midnight), sender's domain."""
    if sender_domain is not None:
        from mailsieve.functions.signals import domain_of

        scans = scans.where(domain_of("sender") == sender_domain.lower())
    if label is not None:
        if label not in ("safe", "spam", "phishing"):
            raise ValueError(f"bad label {label!r}")
        scans = scans.where(F.col("label") == label)
    if date_from:
        scans = scans.where(F.col("created_at") >= _day(date_from).cast("timestamp"))
    if date_to:
        scans = scans.where(F.col("created_at") < F.date_add(_day(date_to), 1).cast("timestamp"))
    return scans


def export_rows(scans: DataFrame, label: str | None = None, date_from: str | None = None,
                date_to: str | None = None) -> DataFrame:
    """The seven export columns, newest first, formula-guarded text."""
    f = filter_scans(scans, label, date_from, date_to)
    return f.select(
        F.col("id"),
        iso_timestamp("created_at").alias("created_at"),
        excel_safe("subject").alias("subject"),
        excel_safe("sender").alias("sender"),
        F.coalesce(F.col("label"), F.lit("")).alias("label"),
        F.col("confidence"),
        F.coalesce(F.col("reasons"), F.lit("")).alias("reasons"),
    ).orderBy(F.desc("id"))


def export_csv(scans: DataFrame, path: str, **filters) -> None:
    """A15 sink: one CSV file set with a header; range-partitioned by id for order."""
    export_rows(scans, **filters).write.mode("overwrite").option("header", True).csv(path)


def payload(scans: DataFrame) -> DataFrame:
    """API payload projection (ISO time, reasons split on ', ')."""
    return scans.select(
        "id", "email_id", "label",
        F.col("confidence"),
        F.when(F.coalesce(F.col("reasons"), F.lit("")) == "", F.array().cast("array<string>"))
        .otherwise(F.split("reasons", ", ")).alias("reasons"),
        iso_timestamp("created_at").alias("created_at"),
        "subject", "sender", "body_preview",
    )


def confidence_violations(scans: DataFrame) -> DataFrame:
    """Rows breaking ``0 <= confidence <= 1``."""
    return scans.where(~F.col("confidence").between(0.0, 1.0))


def apply_defaults(scans: DataFrame) -> DataFrame:
    """Column defaults for missing values."""
    return (scans.withColumn("label", F.coalesce("label", F.lit("safe")))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
            .withColumn("created_at", F.coalesce("created_at", F.current_timestamp())))


def counts_per_label_day(scans: DataFrame) -> DataFrame:
    """Scans per label per day."""
    return scans.groupBy(F.to_date("created_at").alias("day"), "label").agg(F.count(F.lit(1)).alias("n"))


def apply_corrections(scans: DataFrame, corrections: DataFrame) -> DataFrame:
    """The latest user correction per scan overrides the predicted label.

    ``corrections`` is (scan_id, new_label, at); ``max_by`` combines map-side,
    so a scan corrected many times costs one row per map task.
    """
    latest = corrections.groupBy("scan_id").agg(F.max_by("new_label", "at").alias("new_label"))
    j = scans.join(latest.withColumnRenamed("scan_id", "id"), "id", "left")
    return j.withColumn("predicted", F.col("label")).withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def json_columns(scans: DataFrame) -> DataFrame:
    """JSON text for the dynamic columns (flags, probabilities, details), at the export boundary."""
    out = scans
    for c in ("header_flags", "probs", "details"):
        if c in scans.columns:
            out = out.withColumn(c, F.to_json(F.col(c)))
    return out
