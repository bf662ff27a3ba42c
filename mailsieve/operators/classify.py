"""Rule classifier (M1) and header/URL flags (M2) as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions import constants as K
from mailsieve.functions.signals import auth_result, contains_any, domain_of
from mailsieve.functions.text import _c, any_ip_url, any_punycode_url, rule_urls

RULE_STRUCT = "struct<label:string,confidence:double,score:double,reasons:array<string>>"


def rule_signals(text_lower, urls) -> Column:
    """M1 signals from the lower-cased text and its rule URLs (H8).

    The score is accumulated in the same order and with the same DOUBLE
    constants as the rule set (urgent -> raw-ip URL -> punycode -> credential),
    so cut-off comparisons round identically.
    """
    tl, u = _c(text_lower), _c(urls)
    urgent = contains_any(tl, K.URGENT_PHRASES)
    ip = any_ip_url(u)
    puny = any_punycode_url(u)
    cred = contains_any(tl, K.CREDENTIAL_PHRASES)
    spammy = contains_any(tl, K.MARKETING_PHRASES)
    w = K.RULE_WEIGHTS
    score = F.lit(0.0)
    for flag, key in ((urgent, "urgent"), (ip, "ip_url"), (puny, "punycode"), (cred, "credential")):
        score = score + F.when(flag, F.lit(float(w[key]))).otherwise(F.lit(0.0))
    return F.struct(urgent.alias("urgent"), ip.alias("ip"), puny.alias("puny"), cred.alias("cred"),
                    spammy.alias("spammy"), (F.size(u) > 0).alias("any_url"), score.alias("score"))


def classify_text(text) -> Column:
    """M1 signal struct for a text column (single-expression form)."""
    t = F.coalesce(_c(text), F.lit(""))
    return rule_signals(F.lower(t), rule_urls(t))


def rule_decision(signals: Column) -> Column:
    """Turns the signal struct of ``classify_text`` into (label, confidence, score, reasons)."""
    s = signals
    score = s["score"]
    r = K.REASON_TEXT
    reasons = F.filter(
        F.array(
            F.when(s["urgent"], F.lit(r["urgent"])),
            F.when(s["ip"], F.lit(r["ip_url"])),
            F.when(s["puny"], F.lit(r["punycode"])),
            F.when(s["cred"], F.lit(r["credential"])),
            F.when(s["spammy"] & (score < F.lit(K.MARKETING_REASON_BELOW)), F.lit(r["marketing"])),
        ),
        lambda x: x.isNotNull(),
    )
    phishing = score >= F.lit(K.PHISHING_CUTOFF)
    label = F.when(phishing, F.lit("phishing")).when(s["spammy"], F.lit("spam")).otherwise(F.lit("safe"))
    conf = (
        F.when(phishing, F.least(F.lit(K.PHISHING_CONF_CAP), F.lit(0.5) + score / F.lit(2.0)))
        .when(s["spammy"], F.lit(K.SPAM_CONFIDENCE))
        .when(s["urgent"] | s["cred"] | s["any_url"], F.lit(K.SAFE_CONFIDENCE_SIGNALS))
        .otherwise(F.lit(K.SAFE_CONFIDENCE_CLEAN))
    )
    return F.struct(label.alias("label"), conf.alias("confidence"), score.alias("score"), reasons.alias("reasons"))


def classify(text) -> Column:
    """M1 in one call: struct(label, confidence, score, reasons)."""
    return rule_decision(classify_text(text))


def with_rules(df: DataFrame, text_col: str = "body_text", out: str = "rule") -> DataFrame:
    """M1 as a DataFrame step: adds struct ``out`` (label, confidence, score, reasons).

    The signal struct (all phrase and URL scans) is projected first and the
    decision reads it from a column: written as one expression, the branches
    of the decision would re-run the scans (no subexpression elimination
    inside conditional branches).
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    x = df.withColumn("__tl", F.lower(t)).withColumn("__urls", rule_urls(t))
    x = x.withColumn("__sig", rule_signals(F.col("__tl"), F.col("__urls")))
    return x.withColumn(out, rule_decision(F.col("__sig"))).drop("__tl", "__urls", "__sig")


def with_rule_label(df: DataFrame, text_col: str = "body_text", prefix: str = "") -> DataFrame:
    """Adds ``label, confidence, rule_score, reasons`` columns."""
    tmp = "__rule"
    return (
        with_rules(df, text_col, tmp)
        .withColumn(f"{prefix}label", F.col(f"{tmp}.label"))
        .withColumn(f"{prefix}confidence", F.col(f"{tmp}.confidence"))
        .withColumn(f"{prefix}rule_score", F.col(f"{tmp}.score"))
        .withColumn(f"{prefix}reasons", F.col(f"{tmp}.reasons"))
        .drop(tmp)
    )


FLAG_NAMES = (
    "has_html", "has_text", "urls_count", "url_has_ip", "url_has_punycode",
    "reply_to_mismatch", "return_path_mismatch", "spf_fail", "dkim_fail", "dmarc_fail",
)


def header_flags(has_html, has_text, urls, sender, reply_to, return_path,
                 spf_result, dkim_result, dmarc_result) -> Column:
    """M2: the 10 integer flags of a parsed message, as a struct."""
    sd, rd, pd_ = domain_of(sender), domain_of(reply_to), domain_of(return_path)
    u = F.coalesce(_c(urls), F.array().cast("array<string>"))

    def i(c):
        return F.coalesce(c, F.lit(False)).cast("int")

    def fail(x):
        return i(F.lower(F.coalesce(_c(x), F.lit(""))) == "fail")

    return F.struct(
        i(F.coalesce(_c(has_html), F.lit(0)) != 0).alias("has_html"),
        i(F.coalesce(_c(has_text), F.lit(0)) != 0).alias("has_text"),
        F.size(u).cast("int").alias("urls_count"),
        i(any_ip_url(u)).alias("url_has_ip"),
        i(any_punycode_url(u)).alias("url_has_punycode"),
        i((sd != "") & (rd != "") & (sd != rd)).alias("reply_to_mismatch"),
        i((sd != "") & (pd_ != "") & (sd != pd_)).alias("return_path_mismatch"),
        fail(spf_result).alias("spf_fail"),
        fail(dkim_result).alias("dkim_fail"),
        fail(dmarc_result).alias("dmarc_fail"),
    )


def parsed_from_view(df: DataFrame) -> DataFrame:
    """Adds the parsed-message columns (urls, auth results, received_ips, has_*)
    to a header/body view such as ``sources.tables.email_view``."""
    from mailsieve.functions.signals import received_ips
    from mailsieve.functions.text import distinct_urls, extract_urls

    html = F.col("html_raw") if "html_raw" in df.columns else F.lit("")
    out = df
    if "html_raw" not in df.columns:
        out = out.withColumn("html_raw", F.lit(""))
    return (
        out.withColumn("urls", distinct_urls(extract_urls("body_text"), extract_urls(html)))
        .withColumn("spf_result", auth_result("auth_results", "spf"))
        .withColumn("dkim_result", auth_result("auth_results", "dkim"))
        .withColumn("dmarc_result", auth_result("auth_results", "dmarc"))
        .withColumn("received_ips", received_ips("received"))
        .withColumn("has_text", (F.coalesce(F.col("body_text"), F.lit("")) != "").cast("int"))
        .withColumn("has_html", (F.coalesce(html, F.lit("")) != "").cast("int"))
    )


def with_header_flags(df: DataFrame, out: str = "header_flags") -> DataFrame:
    return df.withColumn(out, header_flags("has_html", "has_text", "urls", "sender", "reply_to", "return_path",
                                           "spf_result", "dkim_result", "dmarc_result"))
