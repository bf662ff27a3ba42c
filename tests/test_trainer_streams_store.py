"""The softmax trainer, the streams that keep state, the stored scan table and equal-depth buckets."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailsieve.functions.constants import CLASSES
from mailsieve.operators import metrics as M
from mailsieve.operators import softmax as S
from mailsieve.operators.scan_store import ScanStore


# --- trainer (M9) ----------------------------------------------------------------------------------------------

def _toy(r, n, classes=CLASSES):
    rows, labels = [], []
    for i in range(n):
        y = r.choice(classes)
        labels.append((i, y))
        for t in {r.choice("abcdef") for _ in range(3)} | {f"only-{y}"}:
            rows.append((i, "word", t, round(r.random() + 0.1, 3)))
    return rows, labels


def _adamw(rows, labels, terms, classes, epochs, batches, lr, decay, seed):
    import hashlib

    docs = defaultdict(list)
    for i, ns, t, v in rows:
        docs[i].append(((ns, t), v))
    y = {i: classes.index(c) for i, c in labels}
    per = Counter(y.values())
    weight = {c: len(y) / (len(per) * n) for c, n in per.items()}
    batch = {i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % batches for i in y}
    k, t = len(classes), 0
    w, m, v = ({x: [0.0] * k for x in terms + [("bias", "")]} for _ in range(3))
    for _ in range(epochs):
        for b in range(batches):
            own = [i for i in y if batch[i] == b]
            if not own:
                continue
            t += 1
            total = sum(weight[y[i]] for i in own)
            g = {x: [0.0] * k for x in w}
            for i in own:
                x = docs[i] + [(("bias", ""), 1.0)]
                z = [sum(val * w[f][c] for f, val in x) for c in range(k)]
                e = [math.exp(a - max(z)) for a in z]
                for c in range(k):
                    d = weight[y[i]] * (e[c] / sum(e) - (c == y[i])) / total
                    for f, val in x:
                        g[f][c] += val * d
            for f in w:
                for c in range(k):
                    m[f][c] = 0.9 * m[f][c] + 0.1 * g[f][c]
                    v[f][c] = 0.999 * v[f][c] + 0.001 * g[f][c] ** 2
                    w[f][c] = w[f][c] * (1 - lr * decay) - lr * (m[f][c] / (1 - 0.9 ** t)) / (math.sqrt(v[f][c] / (1 - 0.999 ** t)) + 1e-8)
    return w


def _frames(spark, rows, labels):
    features = spark.createDataFrame(rows, "doc_id long, ns string, term string, value double")
    return features, spark.createDataFrame(labels, "doc_id long, label string"), features.select("ns", "term").distinct()


def test_weights_match_plain_adamw(spark):
    rows, labels = _toy(random.Random(3), 60)
    features, y, vocab = _frames(spark, rows, labels)
    odd = spark.createDataFrame([(900, None), (901, "unknown"), (None, "spam")], "doc_id long, label string")
    model = S.train(features, y.unionByName(odd), vocab, features, y, epochs=2, batches=4, lr=0.1, weight_decay=0.01)
    expected = _adamw(rows, labels, [tuple(x) for x in vocab.collect()], list(CLASSES), 2, 4, 0.1, 0.01, 42)
    got = {(r["ns"], r["term"]): r["w"] for r in model["last"].collect()}
    assert got.keys() == expected.keys()
    assert all(got[f] == pytest.approx(expected[f], abs=1e-9) for f in got)


def test_training_learns_and_keeps_the_first_best_epoch(spark):
    rows, labels = _toy(random.Random(4), 80)
    features, y, vocab = _frames(spark, rows, labels)
    model = S.train(features, y, vocab, features, y, epochs=4, batches=2, lr=0.4)
    scores = [s for _, s in model["history"]]
    assert max(scores) > 0.95 and model["best_epoch"] == 1 + scores.index(max(scores))
    from mailsieve.operators.score import predict

    p = predict(y.select("doc_id"), features, model["weights"], model["intercepts"], CLASSES).select("doc_id", F.col("label").alias("pred"))
    assert M.macro_recall(p.join(y, "doc_id"), "label", "pred", CLASSES).first()["macro_recall"] == pytest.approx(max(scores))
    assert S.train(features, y.limit(0), vocab, features, y, epochs=1, batches=2)["last"].where("abs(w[0]) > 0").count() == 0


def test_binary_training_selects_by_f2(spark):
    rows, labels = _toy(random.Random(5), 50, ["not_safe", "safe"])
    features, y, vocab = _frames(spark, rows, labels)
    model = S.train(features, y, vocab, features, y, classes=["not_safe", "safe"], epochs=2, batches=2, lr=0.1, score=S.f2_score)
    assert model["history"][-1][1] > 0.9


def test_a_step_shuffles_only_gradients(spark):
    rows, labels = _toy(random.Random(6), 40)
    features, y, vocab = _frames(spark, rows, labels)
    weighted = y.withColumn("weight", F.lit(1.0)).withColumn("batch", F.lit(0))
    part = S._partitioned(S._rows(features, weighted, "doc_id", CLASSES), "doc_id", 4)
    state = vocab.withColumn("w", F.array(*[F.lit(0.0)] * 3)).checkpoint()
    plan = S._gradient(part, state, 1.0, "doc_id", 3, True)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and "ns" in exchanges[0] and "doc_id" not in exchanges[0]
    assert "Python" not in plan and "Arrow" not in plan


# --- streams (T2, X4) --------------------------------------------------------------------------------------------

def _mail(i, mid, body, hour=0):
    return (i, mid, "s", "a@b.c", body, f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00")


def _arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "doc_id long, message_id string, subject string, sender string, body_text string, ts string")
    df.select("*", F.col("ts").cast("timestamp").alias("created_at")).drop("ts").write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("doc_id long, message_id string, subject string, sender string, body_text string, created_at timestamp").parquet(f"{folder}/in")


def test_state_gives_later_messages_the_first_result(spark, tmpdir_path):
    from mailsieve.streaming import stateful

    deliveries = [[_mail(2, "x", "urgent: login now at http://1.2.3.4/"), _mail(1, "x", "a calm note"), _mail(3, "", "other")],
                  [_mail(4, "x", "urgent: login now at http://1.2.3.4/"), _mail(5, "y", None)], [_mail(6, "x", "")]]
    for rows in deliveries:
        stateful.start_scans(_arrive(spark, tmpdir_path, rows), f"{tmpdir_path}/scans", f"{tmpdir_path}/ck").awaitTermination()
    got = {r["id"]: r for r in spark.read.parquet(f"{tmpdir_path}/scans").collect()}
    assert sorted(got) == [2, 3, 4, 5, 6, 7]
    assert {i for i in got if got[i]["new_email"]} == {2, 4, 6}
    assert {got[i]["body_preview"] for i in (2, 3, 5, 7)} == {"a calm note"} and len({got[i]["label"] for i in (2, 3, 5, 7)}) == 1
    assert got[2]["body_text"] == "a calm note" and got[7]["body_text"] is None
    assert [got[i]["header_flags"]["has_text"] for i in (2, 5, 7)] == [1, 1, 0]  # flags are the message's own


def test_late_scans_are_counted_apart(spark, tmpdir_path):
    from mailsieve.streaming import stateful

    def scans(rows):
        df = spark.createDataFrame(rows, "ts string, label string").select(F.col("ts").cast("timestamp").alias("created_at"), "label")
        df.write.mode("append").parquet(f"{tmpdir_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmpdir_path}/in")
        for q in stateful.start_counts(stream, f"{tmpdir_path}/out", f"{tmpdir_path}/ck"):
            q.awaitTermination()

    scans([("2024-01-01 10:00:00", "spam"), ("2024-01-04 10:00:00", "safe"), (None, "safe")])
    scans([("2024-01-01 23:00:00", "spam"), ("2024-01-03 11:00:00", "spam"), ("2024-01-02 12:00:00", "safe")])
    scans([("2024-01-10 00:00:00", "safe"), ("2024-01-04 12:00:00", "safe")])
    scans([("2024-01-04 13:00:00", "safe")])
    got = {(str(r["day"]), r["label"]): (r["n"], r["n_late"]) for r in stateful.read_counts(spark, f"{tmpdir_path}/out").collect()}
    assert got == {("2024-01-01", "spam"): (1, 1), ("2024-01-02", "safe"): (0, 1), ("2024-01-03", "spam"): (1, 0),
                   ("2024-01-04", "safe"): (2, 1), ("2024-01-10", "safe"): (1, 0), ("None", "safe"): (0, 1)}


# --- stored scans (C5, B8, F1) -----------------------------------------------------------------------------------

def _scans(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    return df.select("id", F.format_string("e%d", "id").alias("email_id"), F.when(F.col("id") % 3 == 0, "spam").otherwise("safe").alias("label"),
                     F.when(F.col("id") % 50 != 7, F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7200)).alias("created_at"))


def test_pages_from_the_rank_index(spark, tmpdir_path):
    store = ScanStore(spark, f"{tmpdir_path}/store", width=16)
    assert store.page(2, 10)[1]["total"] == 0
    ids = [i for i in range(1, 400) if i % 11 and not 100 < i < 180]
    for part in (ids[:90], ids[90:91], ids[91:]):
        store.append(_scans(spark, part))
    newest = sorted(ids, reverse=True)
    for page, size in ((1, 10), (2, 7), (9, 10), (12, 25), (500, 10), (3, 100)):
        rows, meta = store.page(page, size)
        pages = -(-len(ids) // size)
        at = (min(page, pages) - 1) * size
        assert [r["id"] for r in rows.collect()] == newest[at:at + size]
        assert meta == {"total": len(ids), "page": min(page, pages), "pages": pages, "page_size": size}
    assert [r["id"] for r in store.lookup(92).collect()] == [92] and store.lookup(110).count() == 0 and store.lookup(-5).count() == 0
    assert [r["id"] for r in store.lookup(57).collect()] == [57]  # its range has a scan without a day
    assert {r["id"] for r in store.between("2024-01-03", "2024-01-04", "spam").collect()} == {
        i for i in ids if 24 <= i < 48 and i % 3 == 0 and i % 50 != 7}
    with pytest.raises(ValueError, match="are stored"):
        store.append(_scans(spark, [399]))
    with pytest.raises(Exception, match="needs an id"):
        ScanStore(spark, f"{tmpdir_path}/other").append(_scans(spark, [None]))


def test_stored_scans_are_pruned(spark, tmpdir_path):
    store = ScanStore(spark, f"{tmpdir_path}/store", width=16)
    store.append(_scans(spark, [i for i in range(1, 300) if i % 50 != 7]))

    def scan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return next(x for x in text.split("\n") if "PartitionFilters" in x)

    one = scan(store.lookup(42))
    assert "PartitionFilters: [isnotnull(day" in one and "EqualTo(id,42)" in one
    assert "PartitionFilters: [isnotnull(day" in scan(store.between("2024-01-03", "2024-01-04"))
    rows, _ = store.page(20, 10)
    assert "GreaterThanOrEqual(id," in scan(rows) and "LessThan(id," in scan(rows) and "day" in scan(rows).split("PartitionFilters")[1].split("]")[0]
    read = rows._jdf.queryExecution().executedPlan().toString()
    assert "limit=10" in read.replace(" ", "") or "TakeOrdered" in read
    # the page is cut from one or two ranges of the index, whatever its number
    assert len(store._newest(store.ranks().where("below < 110 AND below + n > 100"))) <= 2


# --- equal-depth buckets (E4) --------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["uniform", "saturated", "constant", "odd"])
def test_buckets_are_even(spark, kind):
    n, buckets = 100_000, 64
    i = F.col("id").cast("double")
    score = {"uniform": (i + 0.5) / n, "saturated": F.lit(1.0) - F.exp(-30 * (i + 1) / n), "constant": F.lit(0.25) + 0 * i,
             "odd": F.when(F.col("id") < 3, F.lit(None)).when(F.col("id") < 5, F.lit(float("nan"))).otherwise(i - 50.0)}[kind]
    df = spark.range(n).select(score.alias("s"), (F.col("id") % 2).alias("y"))
    rows = M.bucketed_counts(df, "s", "y", buckets).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("bucket").collect()
    distinct = sum(r["n"] for r in rows)
    assert max(r["n"] for r in rows) <= 2 * max(distinct / buckets, 1) + 1
    assert all(a["high"] < b["low"] for a, b in zip(rows, rows[1:]) if a["high"] is not None)
    top = M.cumulative_counts(df, "s", "y", buckets).agg(F.max("tp"), F.max("fp")).first()
    assert tuple(top) == (n // 2, n // 2)


# --- resampling (M12), temperature (M13), session ------------------------------------------------------------------

def test_draws_with_replacement(spark):
    from mailsieve.operators.train import weighted_resample

    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1900, "safe").when(F.col("id") < 1999, "spam").otherwise("phishing").alias("label"),
                                  F.lit("x").alias("__n"))
    drawn = weighted_resample(df.repartition(5))
    assert drawn.columns == df.columns and drawn.count() == 2000
    per = {r["label"]: (r["n"], r["k"]) for r in drawn.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("k")).collect()}
    assert all(abs(n - 2000 / 3) < 5 * math.sqrt(2000 / 3) for n, _ in per.values())
    expected = {"safe": 1900 * (1 - math.exp(-2000 / 3 / 1900)), "spam": 99, "phishing": 1}
    assert all(abs(k - expected[c]) <= 60 for c, (_, k) in per.items()) and per["phishing"][1] == 1
    assert sorted(weighted_resample(df.repartition(3)).collect()) == sorted(drawn.collect())  # whatever the partitions
    assert sorted(weighted_resample(df, seed=7).collect()) != sorted(drawn.collect())
    assert weighted_resample(df, n=10).count() == 10 and weighted_resample(df.limit(0)).count() == 0
    with_null = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert weighted_resample(with_null).where("doc_id IS NULL").count() == 0


def test_poisson_cdf(spark):
    from mailsieve.operators.train import poisson_cdf

    for mean in (0.01, 1.0, 16.0):
        cdf = spark.range(1).select(poisson_cdf(F.lit(mean))).first()[0]
        exact = [sum(math.exp(-mean) * mean ** j / math.factorial(j) for j in range(k + 1)) for k in range(61)]
        assert cdf == pytest.approx(exact, abs=1e-12)


def test_temperature_by_newton_steps(spark):
    r = random.Random(2)
    rows = []
    for _ in range(400):
        z = [r.gauss(0, 3) for _ in range(3)]
        weights = [math.exp(x / 2.5) for x in z]
        rows.append((z, r.choices(range(3), weights)[0]))

    def nll(t):
        return sum(math.log(sum(math.exp(x / t) for x in z)) - z[y] / t for z, y in rows) / len(rows)

    df = spark.createDataFrame(rows, "logits array<double>, y int").checkpoint()
    t = M.fit_temperature(df, "logits", "y")
    assert 1.5 < t < 4 and nll(t) <= min(nll(t * 1.001), nll(t / 1.001))
    assert M.fit_temperature(df.limit(0), "logits", "y") == 1.0
    sure = spark.createDataFrame([([5.0, 0.0], 0), ([0.0, 3.0], 1)], "logits array<double>, y int")
    assert M.fit_temperature(sure, "logits", "y") < 0.2  # the sharper the better, until the slope is 0 in doubles
    wrong = spark.createDataFrame([([5.0, 0.0], 1), ([0.0, 3.0], 0)], "logits array<double>, y int")
    assert M.fit_temperature(wrong, "logits", "y") > 1e6


def test_checkpoint_folder_without_a_preset(tmpdir_path):
    import os
    import subprocess
    import sys

    code = ("from mailsieve.session import checkpoint_dir, get_spark; s = get_spark('t', cpus=1); d = checkpoint_dir(s); "
            "assert d and checkpoint_dir(s) and s.range(3).checkpoint().count() == 3; print('fine')")
    env = {**os.environ, "SPARK_CONF_DIR": tmpdir_path, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_ngrams_match_plain_counting(monkeypatch):
    import pyarrow as pa
    import regex

    from mailsieve.functions.text import WORD_TOKEN
    from mailsieve.operators import features as FE

    r = random.Random(1)
    texts = ["".join(r.choice("ab cé中\0𝒳 the and xx yy") for _ in range(r.randrange(60))) for _ in range(300)] + ["", None, "a", "ab", "the", "abcdef"]
    token, stop = regex.compile(WORD_TOKEN), {"the", "and"}
    expected = {}
    for i, x in enumerate(t or "" for t in texts):
        words = [t for t in token.findall(x) if t not in stop]
        grams = [("word", " ".join(words[j:j + n])) for n in (1, 2) for j in range(len(words) - n + 1)]
        for one in grams + [("char", x[j:j + n]) for n in (3, 4, 5) for j in range(len(x) - n + 1)]:
            expected[i, *one] = expected.get((i, *one), 0) + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(texts)], ["key", "w", "c"])
    for size in (1 << 20, 50):  # texts of one slice, and slices of a few texts
        monkeypatch.setattr(FE, "SLICE", size)
        rows = [x for out in FE._count_terms((1, 2), (3, 5), stop)([batch]) for x in zip(*(c.to_pylist() for c in out.columns))]
        assert len(rows) == len(expected) and {tuple(x[:3]): x[3] for x in rows} == expected
    assert list(FE._count_terms((1, 2), (3, 5), stop)([batch.slice(0, 0)])) == []
