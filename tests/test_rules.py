"""Rule classifier, header flags and scalar functions against FIXTURES.md values."""

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import signals as S
from mailsieve.functions import text as T
from mailsieve.operators.classify import with_rules

# (text, label, confidence, reasons) as the shipped rules give them
CASES = [
    ("Urgent action required! Click here to verify your account and you are a winner", "safe", 0.5, ["urgent language"]),
    ("You are a WINNER of FREE money, work from home!", "safe", 0.7, []),
    ("hello there, just checking in", "safe", 0.7, []),
    ("verify your account", "safe", 0.5, ["urgent language"]),
    ("verify your account -- urgent action required", "safe", 0.5, ["urgent language"]),
    ("verify your account -- urgent action required -- click here", "safe", 0.5, ["urgent language"]),
    ("hello " * 10000 + " verify your password " + "world " * 10000, "safe", 0.7, []),
    ("", "safe", 0.7, []),
    ("Urgent: login now", "phishing", 0.8, ["urgent language", "credential lure"]),
    ("See http://192.168.10.5/login immediately", "phishing", 0.85, ["urgent language", "url uses raw ip"]),
    ("Special offer, act now", "spam", 0.6, ["marketing language"]),
    ("Visit https://xn--pple-43d.com/ for details", "safe", 0.5, ["punycode url"]),
    ("Limited time: unsubscribe at https://xn--80ak6aa92e.com", "spam", 0.6, ["urgent language", "punycode url"]),
    ("Final notice http://10.0.0.1 https://xn--a.com update your password", "phishing", 0.99,
     ["urgent language", "url uses raw ip", "punycode url", "credential lure"]),
    ("Notes at HTTPS://example.org/a, and (http://example.com/b).", "safe", 0.5, []),
]


def test_rule_classifier_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_rest) in enumerate(CASES)], "i int, body_text string")
    got = {r["i"]: r for r in with_rules(df).select("i", "rule.*").collect()}
    for i, (_t, label, conf, reasons) in enumerate(CASES):
        assert got[i]["label"] == label, i
        assert got[i]["confidence"] == pytest.approx(conf), i
        assert list(got[i]["reasons"]) == reasons, i


def test_url_rules_differ(spark):
    df = spark.createDataFrame([("Notes at HTTPS://example.org/a, and (http://example.com/b).",)], "t string")
    r = df.select(T.rule_urls("t").alias("a"), T.extract_urls("t").alias("b")).first()
    assert list(r["a"]) == ["http://example.com/b)."]
    assert list(r["b"]) == ["HTTPS://example.org/a", "http://example.com/b"]


def test_ip_host_rule(spark):
    cases = [("http://1.2.3.4/x", True), ("http://user@1.2.3.4:80/", True), ("http://1.2.3.4", True),
             ("http://1.2.3.4.", False), ("http://10.0.0.1,", False), ("http://a.com/1.2.3.4", False),
             ("https://999.1.1.1?q", True)]
    df = spark.createDataFrame(cases, "u string, want boolean")
    for r in df.select("want", T.url_host_is_ip("u").alias("got")).collect():
        assert r["want"] == r["got"]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("  A  b\r\n c ", "=1+1", "mx; SPF=SoftFail; spf=pass; DKIM = fail", "a", "", "c")],
                               "t string, x string, h string, to string, cc string, bcc string")
    r = df.select(T.normalize_text("t").alias("n"), T.normalize_body("t").alias("b"), S.excel_safe("x").alias("e"),
                  S.auth_result("h", "spf").alias("spf"), S.auth_result("h", "dkim").alias("dkim"),
                  S.auth_result("h", "dmarc").alias("dmarc"), S.recipients("to", "cc", "bcc").alias("rc"),
                  S.redact_dsn(F.lit("postgresql://bob:secret@db:5432/x")).alias("dsn"),
                  T.short_id(F.lit("<m@x>"), F.lit("s"), F.lit(""), F.lit("f")).alias("id")).first()
    assert r["n"] == "a b c" and r["b"] == "A b c" and r["e"] == "'=1+1"
    assert (r["spf"], r["dkim"], r["dmarc"]) == ("softfail", "fail", None)
    assert r["rc"] == "a;;c"
    assert r["dsn"] == "postgresql://***:***@db:5432/x"
    import hashlib

    h = hashlib.sha256()
    for v in ("<m@x>", "s", "", "f"):
        h.update(v.encode())
        h.update(b"\0")
    assert r["id"] == h.hexdigest()[:16]


def test_html_to_text(spark):
    df = spark.createDataFrame([("<html><style>p{}</style><script>var a='<p>';</script><p>A &amp;lt; b&nbsp;c</p></html>",)], "h string")
    assert df.select(T.html_to_text("h").alias("t")).first()["t"] == "A &lt; b c"


def test_rfc2822_and_iso(spark):
    df = spark.createDataFrame([("Tue, 1 Jul 2003 10:52:37 +0200",), ("not a date",)], "d string")
    got = [r["t"] for r in df.select(S.iso_timestamp(S.parse_rfc2822("d")).alias("t")).collect()]
    assert got == ["2003-07-01T08:52:37", ""]
