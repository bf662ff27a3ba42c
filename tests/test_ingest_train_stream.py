"""Mail-file ingest, training and streaming, on small files the tests write."""

import os

from pyspark.sql import functions as F

from mailsieve.sources import mail as ML

PLAIN = b"From: a@x.com\r\nSubject: hi\r\nContent-Type: text/plain\r\n\r\nThis is a plain body that is long enough.\r\n"
MULTI = (b"From: b@y.com\r\nSubject: m\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=XX\r\n"
         b"Authentication-Results: mx; spf=FAIL; spf=pass; dkim=pass\r\n"
         b"Received: from a (9.9.9.9) by b\r\nReceived: from c (9.9.9.9) by d (8.8.8.8)\r\n\r\n"
         b"--XX\r\nContent-Type: text/plain\r\n\r\nplain wins over html in this message http://1.2.3.4/x\r\n"
         b"--XX\r\nContent-Type: text/html\r\n\r\n<p>html part &amp; more</p>\r\n"
         b"--XX\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nJVBE\r\n--XX--\r\n")
HTML = (b"From: c@z.com\r\nContent-Type:\r\n text/html; charset=utf-8\r\n\r\n"
        b"<html><script>x()</script><style>p{}</style><p>Hello &amp; welcome to the html only message</p></html>")


def _write(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_ingest_corpus(spark, tmpdir_path):
    root = tmpdir_path
    _write(root, "spam/1.eml", PLAIN)
    _write(root, "spam/2.eml", MULTI)
    _write(root, "easy_ham/3.eml", HTML)
    _write(root, "easy_ham/4.eml", b"From: d@q.com\r\n\r\nshort")
    _write(root, "easy_ham/5.eml", b"")  # seen and empty, though Spark's own file scan leaves it out
    _write(root, "easy_ham/6.eml", b"From: g@q.com\r\n\r\n   \r\n")
    _write(root, "easy_ham/bad.eml", b"From: e@q.com\r\n\r\nbad bytes \xff\xfe here and more text to pass")
    _write(root, "easy_ham/a.tar.gz", b"xx")
    _write(root, "easy_ham/big.eml", b"From: f@q.com\r\n\r\n" + b"x" * 3000)
    rows, counters, ctypes = ML.ingest_corpus(spark, root, source="spamassassin", max_bytes=2000)
    got = {r["relpath"]: r for r in rows.collect()}
    assert set(got) == {"spam/1.eml", "spam/2.eml", "easy_ham/3.eml", "easy_ham/bad.eml"}
    assert got["spam/2.eml"]["body_text"].startswith("plain wins") and got["spam/2.eml"]["label"] == "spam"
    assert got["easy_ham/3.eml"]["body_text"] == "Hello & welcome to the html only message"
    c = counters.first()
    assert (c["files_seen"], c["archives_skipped"], c["oversize_skipped"], c["candidates"]) == (9, 1, 1, 7)
    assert (c["extracted_ok"], c["empty_after_parse"], c["too_short"]) == (4, 2, 1)
    assert {r["ctype"] for r in ctypes.collect()} >= {"text/plain", "text/html", "multipart/mixed"}


def test_parse_rfc822(spark, tmpdir_path):
    _write(tmpdir_path, "m/2.eml", MULTI)
    p = ML.parse_rfc822(ML.read_messages(spark, tmpdir_path)).first()
    assert p["spf_result"] == "fail" and p["dkim_result"] == "pass"
    assert list(p["received_ips"]) == ["9.9.9.9", "8.8.8.8"]
    assert list(p["attachments"]) == ["a.pdf"] and p["has_html"] == 1 and p["has_text"] == 1
    assert list(p["urls"]) == ["http://1.2.3.4/x"]


def test_train_job_beats_majority(spark):
    from mailsieve.operators.train import train_job
    from mailsieve.sources.tables import email_view

    v = email_view(spark, "/root/testdata/sf0.01")
    # a learnable target: the label follows the appended snippet
    corpus = v.select("doc_id", "body_text", F.when(F.col("doc_id") % 8 == 3, "spam")
                      .when(F.col("doc_id") % 8 == 6, "phishing").otherwise("ham").alias("label"))
    for model in ("nb", "logreg"):
        res = train_job(corpus, model=model, reg_params=(1e-3,), max_features={"word": 5000})
        acc = res["accuracy"].first()["accuracy"]
        assert acc > 0.75, (model, acc)  # majority class is 75 %


def test_stream_scan_is_replay_safe(spark, tmpdir_path):
    from mailsieve.streaming.scan_stream import start_mail_stream

    mail = os.path.join(tmpdir_path, "in")
    _write(mail, "1.eml", PLAIN)
    _write(mail, "2.eml", MULTI)
    _write(mail, "3.eml", PLAIN)  # same id as 1.eml: one stored e-mail
    out_e, out_s = os.path.join(tmpdir_path, "emails"), os.path.join(tmpdir_path, "scans")
    q = start_mail_stream(spark, mail, out_e, out_s, checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(out_s).count() == 3
    assert spark.read.parquet(out_e).count() == 2
    _write(mail, "4.eml", PLAIN)  # later batch, existing id -> no new e-mail
    q = start_mail_stream(spark, mail, out_e, out_s, checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(out_s).count() == 4
    assert spark.read.parquet(out_e).count() == 2


def test_two_streams_into_one_table(spark, tmpdir_path):
    from mailsieve.streaming.scan_stream import start_mail_stream

    out_e, out_s = os.path.join(tmpdir_path, "emails"), os.path.join(tmpdir_path, "scans")
    for k, data in enumerate((PLAIN, MULTI)):  # both begin at epoch 0
        _write(tmpdir_path, f"in{k}/1.eml", data)
        start_mail_stream(spark, os.path.join(tmpdir_path, f"in{k}"), out_e, out_s,
                          checkpoint=os.path.join(tmpdir_path, f"ck{k}")).awaitTermination(120)
    assert spark.read.parquet(out_e).count() == 2
    assert sorted(r["id"] for r in spark.read.parquet(out_s).collect()) == [1, 2]


def test_mime_details(spark):
    mails = [
        b"Subject: =?utf-8?Q?caf=C3=A9_=3D?= =?iso-8859-1?B?6Q==?= end\r\nFrom: a@b.c\r\nContent-Type: text/plain; charset=iso-8859-1\r\n"
        b"Content-Transfer-Encoding: quoted-printable\r\n\r\nna=EFve =\r\nline\r\n",
        b"\r\nno headers at all", b"", None,
        b"Content-Type: multipart/mixed; boundary=a.b\r\n\r\nno delimiter here",
        b"Content-Type: text/html\r\nContent-Transfer-Encoding: base64\r\n\r\nPGI+aGkmZWFjdXRlOzwvYj4=",
    ]
    df = spark.createDataFrame(list(enumerate(mails)), "path long, content binary")
    got = {r["path"]: r for r in ML.parse_rfc822(df.withColumn("path", F.col("path").cast("string"))).collect()}
    assert got["0"]["subject"] == "café =é end" and got["0"]["body_text"] == "naïve line\n"
    assert got["1"]["body_text"] == "no headers at all" and got["1"]["subject"] == ""
    assert got["2"]["body_text"] == got["3"]["body_text"] == ""
    assert got["4"]["attachments_count"] == 0
    assert got["5"]["has_html"] == 1 and got["5"]["body_text"] == "hié"


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert set(df.columns) == {"label", "n_scans", "n_emails", "mean_confidence"}
    assert df.count() >= 1
    assert set(E.oracle_sql()) <= set(E.queries())


def test_view_stream_matches_batch(spark, tmpdir_path):
    from mailsieve.operators.classify import parsed_from_view
    from mailsieve.operators.scans import scan_emails
    from mailsieve.sources.tables import email_view
    from mailsieve.streaming.scan_stream import start_view_stream

    sf = "/root/testdata/sf0.001"
    out_e, out_s = os.path.join(tmpdir_path, "emails"), os.path.join(tmpdir_path, "scans")
    q = start_view_stream(spark, sf, out_e, out_s, checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(180)
    streamed = spark.read.parquet(out_s).select("id", "label")
    batch, emails = scan_emails(parsed_from_view(email_view(spark, sf)))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select("id", "label")).count() == 0
    assert spark.read.parquet(out_e).count() == emails.count()


def test_training_query_selects_over_the_whole_grid(monkeypatch):
    import inspect

    from mailsieve.operators.train import train_job
    from mailsieve.plans import q_score

    asked = {}
    monkeypatch.setattr(q_score, "corpus_view", lambda spark, sf: None)
    monkeypatch.setattr(q_score, "train_job", lambda corpus, **kw: asked.update(kw) or {"report": None})
    q_score.m09_train_logreg(None, "")
    default = inspect.signature(train_job).parameters["reg_params"].default
    assert asked.get("reg_params", default) == default
