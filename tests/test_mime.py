"""The native MIME parse: nothing of a text is lost, charsets and parameters are read, structure as the standard parser sees it."""

import email
import random
from email import policy

from pyspark.sql import functions as F

from mailsieve.sources import mail as ML
from mailsieve.sources import mime


def _parse(spark, mails):
    df = spark.createDataFrame([(str(i), m) for i, m in enumerate(mails)], "path string, content binary")
    rows = {r["path"]: r for r in ML.parse_rfc822(df).collect()}
    return [rows[str(i)] for i in range(len(mails))]


def _mixed(body, boundary="b", extra=b""):
    b = boundary.encode()
    return b"Content-Type: multipart/mixed; boundary=" + b + b"\r\n\r\n--" + b + b"\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n" + body + b"\r\n" + extra + b"--" + b + b"--\r\n"


def test_no_text_is_lost(spark):
    texts = [b"before\x01after", b"says boundary=zz here\n--zz\nand goes on", b"-- \nsignature\n--\n--b-\n--bb\nrest", b"--b--x is no delimiter", b""]
    got = _parse(spark, [_mixed(t.replace(b"\n", b"\r\n")) for t in texts])
    assert [r["body_text"] for r in got] == [t.decode() for t in texts]


def test_charsets(spark):
    cases = {"windows-1252": "it’s 5 €", "cp1251": "Привет", "koi8-r": "Привет, мир", "KOI8-U": "Їжак", "iso-8859-15": "5 €", "ISO_8859-2": "Žluťoučký",
             "iso-8859-1": "naïve", "us-ascii": "plain", "UTF-8": "日本", "utf-16le": "日𝒳", "utf-16": "é", "iso-8859-7": "Ελλάδα", "windows-1255": "שלום"}
    mails = [b"Subject: =?" + c.encode() + b"?Q?" + b"".join(b"=%02X" % x for x in t.encode(c)) + b"?= end\r\nContent-Type: text/plain; charset=\"" + c.encode()
             + b"\"\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n" + b"".join(b"=%02X" % x for x in t.encode(c)) for c, t in cases.items()]
    for r, text in zip(_parse(spark, mails), cases.values()):
        assert r["body_text"] == text and r["subject"] == text + " end"
    odd = [b"Content-Type: text/plain; charset=utf-16be\r\nContent-Transfer-Encoding: base64\r\n\r\n2AAAYdwA", b"Content-Type: text/plain; charset=unheard-of\r\n\r\nab\xff",
           b"Content-Type: text/plain; charset=windows-1252\r\n\r\n\x81"]
    assert [r["body_text"] for r in _parse(spark, odd)] == ["�a�", "ab�", "�"]


def test_every_one_byte_charset_is_its_codec(spark):
    data = bytes(range(32, 256))
    names = sorted(mime.TABLES)
    df = spark.createDataFrame([(n, data) for n in names], "name string, raw binary")
    got = {r["name"]: r["t"] for r in df.select("name", mime.decode(F.col("raw"), F.col("name")).alias("t")).collect()}
    halves = mime._tables()
    assert all(got[n] == data[:96].decode("latin_1") + halves[n] for n in names)
    assert got["windows-1252"] == data.decode("cp1252", "replace") and got["iso-8859-16"] == data.decode("iso8859_16", "replace")


def test_file_names(spark):
    forms = {b'filename="a b.txt"': "a b.txt", b"filename=x.txt": "x.txt", b"filename*=utf-8''na%C3%AFve%20b.txt": "naïve b.txt",
             b"filename*=koi8-r'ru'%F0%D2%C9": "При", b'filename*0="long ";\r\n filename*1="name.txt"': "long name.txt",
             b"filename*1=name.txt; filename*0=long-": "long-name.txt", b"filename*0*=utf-8''%C3%A9; filename*1=tail.txt": "étail.txt",
             b'filename="=?utf-8?B?w6k=?=.txt"': "é.txt", b"filename*0=a; filename=whole.txt": "whole.txt"}
    part = b"--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment;\r\n %s\r\n\r\nx\r\n"
    got = _parse(spark, [_mixed(b"text", extra=part % f) for f in forms])
    assert [r["attachments"] for r in got] == [[n] for n in forms.values()]


def test_forwarded_and_unclosed_parts(spark):
    inner = _mixed(b"inner text", "in")
    forwarded = b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: message/rfc822\r\n\r\nSubject: x\r\n" + inner + b"--b--\r\n"
    unclosed = (b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: multipart/alternative; boundary=c\r\n\r\n--c\r\n\r\nfirst\r\n"
                b"--b\r\nContent-Type: text/html\r\n\r\n<p>two</p>\r\n--c\r\n")  # c is closed by the line of b
    got = _parse(spark, [forwarded, unclosed])
    assert got[0]["body_text"] == "inner text"
    assert got[1]["body_text"] == "first" and got[1]["html_raw"] == "<p>two</p>\n--c\n"


def _random_message(r, depth=0):
    """(bytes of headers, blank line and body)."""
    if depth < 3 and r.random() < (0.9 if depth == 0 else 0.4):
        b = r.choice(["a", "a-b", "b.c", "=_x"]) + str(depth) + str(r.randrange(9))
        parts = [_random_message(r, depth + 1) for _ in range(r.randrange(1, 4))]
        quoted = f'"{b}"' if r.random() < 0.7 or "=" in b else b
        head = f"Content-Type: multipart/mixed; boundary={quoted}\r\n\r\n".encode()
        return head + r.choice([b"", b"preamble\r\n"]) + b"".join(b"--" + b.encode() + b"\r\n" + p + b"\r\n" for p in parts) + b"--" + b.encode() + b"--\r\n"
    lines = [r.choice([b"one line", b"--", b"-- x", b"--a0", b"", b"boundary=a00", b"\x01", b"tail "]) for _ in range(r.randrange(5))]
    head = r.choice([b"Content-Type: text/plain; charset=utf-8\r\n", b"", b"Content-Type: application/pdf\r\n"])
    return head + b"\r\n" + b"\r\n".join(lines)


def test_structure_is_that_of_the_standard_parser(spark):
    r = random.Random(8)
    mails = [b"Subject: s\r\n" + _random_message(r) for _ in range(150)]
    df = spark.createDataFrame([(str(i), m) for i, m in enumerate(mails)], "path string, content binary")
    got = {int(x["path"]): [(p["ctype"], p["text"]) for p in x["parts"]] for x in ML.decode_messages(df).select("path", "parts").collect()}
    for i, m in enumerate(mails):
        whole = email.message_from_bytes(m.replace(b"\r\n", b"\n"), policy=policy.compat32)
        leaves = [(p.get_content_type(), p.get_payload()) for p in whole.walk() if p.get_content_maintype() != "multipart"]
        assert got[i] == leaves, m
