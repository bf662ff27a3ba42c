"""File-level sources and sinks: text decode, CSV corpora, fingerprints, caps, model artifacts, JSON columns."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from mailsieve.sources import mail as ML


def _w(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_read_text_files_body_rule(spark, tmpdir_path):
    _w(tmpdir_path, "spam/a.txt", b"Header: x\r\n\r\nbody with a bad byte \xff that is long enough to keep!!")
    _w(tmpdir_path, "spam/b.txt", b"Header: x\n\nshort")
    _w(tmpdir_path, "easy_ham/c.txt", b"no blank line, whole text is the body and it is longer than forty")
    got = {r["relpath"]: r for r in ML.read_text_files(spark, tmpdir_path).collect()}
    assert set(got) == {"spam/a.txt", "easy_ham/c.txt"}
    assert got["spam/a.txt"]["body_text"] == "body with a bad byte  that is long enough to keep!!"
    assert got["easy_ham/c.txt"]["label"] == "safe"


def test_csv_corpora_fingerprints_and_sinks(spark, tmpdir_path):
    a = _w(tmpdir_path, "in/a.csv", b'body_text,label\n"multi\nline body",ham\nplain,spam\n')
    b = _w(tmpdir_path, "in/b.csv", b"body_text,label,source\nx,phish,s1\n")
    df = ML.read_csv_corpora(spark, [a, b])
    assert df.count() == 3 and "source" in df.columns
    assert df.where(F.col("body_text") == "multi\nline body").count() == 1
    assert df.select("source_file").distinct().count() == 2
    fp = {os.path.basename(r["path"]): r["sha256"] for r in ML.file_fingerprints(spark, [a, b]).collect()}
    assert fp["a.csv"] == hashlib.sha256(open(a, "rb").read()).hexdigest()
    out = os.path.join(tmpdir_path, "out")
    ML.write_csv(df.drop("source_file"), out + "/csv")
    ML.write_parquet(df, out + "/pq")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out + "/csv")
    assert back.count() == 3 and spark.read.parquet(out + "/pq").count() == 3
    bad = _w(tmpdir_path, "in/c.csv", b"text,label\nx,y\n")
    try:
        ML.read_csv_corpora(spark, [bad])
        raise AssertionError("missing column not detected")
    except ValueError as e:
        assert "body_text" in str(e)


def test_many_csv_files_are_one_scan(spark, tmpdir_path):
    heads = (["label", "body_text"], ["body_text", "extra x", "label"], ["id", "label", "body_text", "id"], ["label", "body_text", ""])
    names = []
    for i in range(1000):
        values = [f"{n or 'none'} {i}" for n in heads[i % 4]]
        names.append(_w(tmpdir_path, f"in/{i % 7} a+[b]%/{i:04}.csv", (",".join(heads[i % 4]) + "\n" + ",".join(values) + "\n").encode()))
    df = ML.read_csv_corpora(spark, names)
    assert df.columns == ["label", "body_text", "_c2", "id", "extra x", "source_file"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    got = {r["body_text"]: r for r in df.collect()}
    assert len(got) == 1000
    for i in range(1000):
        r = got[f"body_text {i}"]
        assert r["label"] == f"label {i}" and r["source_file"].endswith(f"/{i:04}.csv")
        assert (r["extra x"], r["id"], r["_c2"]) == (f"extra x {i}" if i % 4 == 1 else None, f"id {i}" if i % 4 == 2 else None,
                                                     f"none {i}" if i % 4 == 3 else None)
    assert ML.read_csv_corpora(spark, [os.path.join(tmpdir_path, "in")]).count() == 1000  # a folder
    long = _w(tmpdir_path, "big.bin", bytes(range(256)) * 80_000)  # more than one range
    fp = ML.file_fingerprints(spark, [*names[:50], long, os.path.join(tmpdir_path, "none.csv")])
    got = {r["path"]: r["sha256"] for r in fp.collect()}
    assert got == {n: hashlib.sha256(open(n, "rb").read()).hexdigest() for n in [*names[:50], long]} | {os.path.join(tmpdir_path, "none.csv"): "NA"}


def test_mail_tree_lists_packs_and_streams(spark, tmpdir_path):
    from mailsieve.sources import mail_tree as MT

    sizes = {f"{i % 3}/{i:03}.eml": i * 37 for i in range(300)} | {".hidden": 4, "a.ZIP": 9, "0/big.eml": 50_000}
    for name, n in sizes.items():
        _w(tmpdir_path, "tree/" + name, b"x" * n)
    root = os.path.join(tmpdir_path, "tree")
    listed = ML.list_files(spark, root)
    assert {r["path"]: r["length"] for r in listed.collect()} == {f"file:{root}/{k}": v for k, v in sizes.items()}
    assert listed.columns == ["path", "length", "modificationTime"]
    read = ML.read_messages(spark, root, max_bytes=20_000)
    assert {r["path"]: r["content"] for r in read.collect()} == {
        f"file:{root}/{k}": bytearray(b"x" * v) for k, v in sizes.items() if v <= 20_000 and not k.endswith("ZIP")}
    parts = MT.pack(MT.files(root), 20_000, 100)
    assert [f for p in parts for f in p.listed] == MT.files(root)  # none lost, none twice
    assert all(len(p.listed) == 1 or sum(f[1] + 100 for f in p.listed) <= 20_000 for p in parts)
    empty = os.path.join(tmpdir_path, "nothing")
    os.makedirs(empty)
    assert ML.read_messages(spark, empty).count() == 0

    def step(to):
        stream = spark.readStream.format("mail_tree").option("log", os.path.join(tmpdir_path, "log")).load(root)
        q = stream.select("path", "length").writeStream.format("parquet").option("path", to).option(
            "checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return {(r["path"], r["length"]) for r in spark.read.parquet(to).collect()}, spark.read.parquet(to).count()

    out = os.path.join(tmpdir_path, "out")
    rows, n = step(out)
    assert n == len(sizes) and rows == {(f"file:{root}/{k}", v) for k, v in sizes.items()}
    _w(tmpdir_path, "tree/1/new.eml", b"")
    os.utime(os.path.join(root, "1/new.eml"), (1, 1))  # older than all others, and yet read
    rows, n = step(out)
    assert n == len(sizes) + 1 and (f"file:{root}/1/new.eml", 0) in rows


def test_candidate_cap_per_folder(spark, tmpdir_path):
    for i in range(5):
        _w(tmpdir_path, f"spam/{i}.eml", b"From: a@b\r\n\r\nthis body is certainly long enough to keep " + bytes([48 + i]))
    rows, counters, _ = ML.ingest_corpus(spark, tmpdir_path, source="sa", max_candidates=3)
    assert rows.count() == 3


def test_model_save_load_and_json(spark, tmpdir_path):
    from mailsieve.operators.scans import json_columns, scan_emails
    from mailsieve.operators.train import load_model, save_model

    w = spark.createDataFrame([("word", "a", "spam", 0.5)], "ns string, term string, label string, weight double")
    v = spark.createDataFrame([("word", "a", 1, 1, 1.5)], "ns string, term string, df long, cf long, idf double")
    rep = spark.createDataFrame([("spam", 1.0)], "class string, f1 double")
    res = {"weights": w, "vocab": v, "classes": ["safe", "spam"], "intercepts": {"safe": 0.1, "spam": -0.1},
           "temperature": None, "tuned_threshold": 0.5, "best": {"reg_param": 0.001}, "report": rep, "confusion": rep}
    save_model(res, os.path.join(tmpdir_path, "m"), version="v1")
    m = load_model(spark, os.path.join(tmpdir_path, "m"))
    assert m["version"] == "v1" and m["intercepts"]["spam"] == -0.1 and m["weights"].count() == 1
    df = spark.createDataFrame([(1, "Urgent: login now")], "doc_id long, body_text string")
    scans, _ = scan_emails(df, created_at=None, model_version="v1")
    j = json_columns(scans).first()
    assert json.loads(j["header_flags"])["has_text"] == 1
    assert json.loads(j["details"])["fallback_reason"] == "heuristics_only" and j["model_version"] == "v1"
