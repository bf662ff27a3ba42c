"""Corpus, scan, decision and metric operators: fixtures and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import corpus as C
from mailsieve.operators import metrics as M
from mailsieve.operators import scans as SC
from mailsieve.operators.score import decide, thresholds_from_json


def test_dedupe_keep_first(spark):
    df = spark.createDataFrame([(1, "A  b", "safe"), (2, "a B", "safe"), (3, "a b", "spam")], "doc_id int, body_text string, label string")
    got = sorted((r["doc_id"], r["label"]) for r in C.dedupe_keep_first(df, "doc_id").collect())
    assert got == [(1, "safe"), (3, "spam")]
    again = C.dedupe_keep_first(C.dedupe_keep_first(df, "doc_id").drop("text_hash"), "doc_id")
    assert again.count() == 2  # idempotent


def test_conflict_spam_wins(spark):
    df = spark.createDataFrame([(1, "same body", "safe"), (2, "same body", "spam"), (3, "other", "safe")],
                               "doc_id int, body_text string, label string")
    got = sorted((r["doc_id"], r["label"]) for r in C.resolve_conflicts(df, "doc_id").collect())
    assert got == [(1, "spam"), (3, "safe")]


def test_canonical_and_training_rows(spark):
    df = spark.createDataFrame([(" Ham ", "x"), ("PHISH", "y"), ("fraud", " "), ("weird", "z"), (None, "w")], "label string, body_text string")
    assert [r[0] for r in df.select(C.canonical_label("label")).collect()] == ["safe", "phishing", "phishing", "weird", None]
    assert C.training_rows(df).count() == 2


DECISIONS = [
    ((0.80, 0.15, 0.05), {"phishing": 0.72, "spam": 0.91}, "phishing", 0.80, "passed_threshold"),
    ((0.60, 0.30, 0.10), {"phishing": 0.72, "spam": 0.91}, "safe", 0.30, "passed_threshold"),
    ((0.60, 0.30, 0.10), {}, "phishing", 0.60, "no_thresholds_configured"),
    ((0.60, 0.30, 0.10), {"phishing": 0.72, "spam": 0.91, "safe": 0.5}, "phishing", 0.60, "no_class_met_threshold"),
]


@pytest.mark.parametrize("probs,thr,label,prob,reason", DECISIONS)
def test_threshold_decision(spark, probs, thr, label, prob, reason):
    df = spark.createDataFrame([(list(probs),)], "p array<double>")
    d = df.select(decide(F.col("p"), ("phishing", "safe", "spam"), thr).alias("d")).first()["d"]
    assert d["winner"]["label"] == label and d["winner"]["prob"] == pytest.approx(prob)
    assert d["fallback_reason"] == reason and d["raw_top"]["label"] == "phishing"


def test_thresholds_json(spark):
    docs = [('{"threshold_suggestions": {"phishing": {"prec_at_95": 0.72, "chosen": 0.72}, "spam": {"prec_at_95": 0.91}}}',),
            ('{"threshold_suggestions": {"phishing": 3, "spam": {"a": 0.2, "b": 0.4}}}',), ("not json",)]
    got = [r["thresholds"] for r in thresholds_from_json(spark.createDataFrame(docs, "json string")).collect()]
    assert got[0] == {"phishing": 0.72, "spam": 0.91}
    assert got[1] == {"spam": 0.4}
    assert got[2] == {}


def test_curves_match_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, round(rnd.random(), 3) if i % 3 else rnd.random(), int(rnd.random() < 0.4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    got = {r["score"]: (r["tp"], r["fp"]) for r in M.cumulative_counts(df, "s", "y", n_buckets=64).collect()}
    for s in rnd.sample(sorted({r[1] for r in rows}), 50):
        tp = sum(1 for r in rows if r[1] >= s and r[2] == 1)
        fp = sum(1 for r in rows if r[1] >= s and r[2] == 0)
        assert got[s] == (tp, fp)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    auc = M.roc_auc(df, "s", "y").first()["roc_auc"]
    ref = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="yd").evaluate(df.withColumn("yd", F.col("y").cast("double")))
    assert auc == pytest.approx(ref, abs=1e-9)


def test_split_is_disjoint_complete_and_stratified(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"),
                                  F.when(F.col("id") % 10 < 6, "safe").when(F.col("id") % 10 < 9, "spam").otherwise("phishing").alias("label"))
    s = M.stratified_split(df, "doc_id", "label", 0.2, 42)
    assert s.count() == 2000 and s.select("doc_id").distinct().count() == 2000
    per = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for lab, n in (("safe", 1200), ("spam", 600), ("phishing", 200)):
        assert per[(lab, "val")] == math.ceil(n * 0.2)
    odd = spark.range(17).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 7, "a").when(F.col("id") < 13, "b").otherwise("c").alias("label"))
    per = {(r["label"], r["split"]): r["count"] for r in M.stratified_split(odd, "doc_id", "label", 0.2, 42).groupBy("label", "split").count().collect()}
    assert sum(n for (_, part), n in per.items() if part == "val") == math.ceil(17 * 0.2)  # 7, 6 and 4 rows: 1 + 1 + 1 and one more


def test_no_single_partition_exchange_on_rows(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 97 / 97.0).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    plan = M.cumulative_counts(df, "s", "y")._jdf.queryExecution().executedPlan().toString()
    # the only single-partition exchange allowed is over the bounded bucket table
    assert plan.count("SinglePartition") <= 1


def test_confusion_sums_to_n(spark):
    df = spark.createDataFrame([("safe", "safe"), ("spam", "safe"), ("phishing", "phishing"), ("spam", "spam")], "label string, pred string")
    cm = M.confusion_matrix(df, "label", "pred", ("phishing", "safe", "spam")).collect()
    assert sum(r["phishing"] + r["safe"] + r["spam"] for r in cm) == 4
    rep = {r["class"]: r for r in M.classification_report(df, "label", "pred", ("phishing", "safe", "spam")).collect()}
    assert rep["accuracy"]["f1"] == pytest.approx(0.75)
    assert rep["spam"]["recall"] == pytest.approx(0.5)


def test_tune_threshold_recall_target(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.2, 0)], "p double, y int")
    r = M.tune_threshold(df, "p", "y", "recall", 0.9).first()
    assert r["threshold"] == pytest.approx(0.8)  # highest recall with precision >= 0.9
    r2 = M.tune_threshold(df, "p", "y", "recall", 1.01).first()
    assert r2["threshold"] == pytest.approx(0.5)


def test_scan_first_wins_and_export(spark):
    rows = [(1, "m1", "S", "a@x.com", "first body urgent"), (2, "m1", "S", "a@x.com", "second body"),
            (3, "m3", "=1+1", "b@y.com", "Special offer, act now")]
    df = spark.createDataFrame(rows, "doc_id long, message_id string, subject string, sender string, body_text string")
    df = df.withColumn("created_at", F.to_timestamp(F.lit("2024-01-02 10:00:00")))
    scans, emails = SC.scan_emails(df)
    assert emails.count() == 2
    got = {r["id"]: r for r in scans.collect()}
    # scan id = doc_id + 1; doc 2 shares doc 1's e-mail id, so doc 1's body is scored (first wins)
    assert got[3]["label"] == "safe" and got[3]["reasons"] == "urgent language"
    assert got[4]["label"] == "spam"
    exp = SC.export_rows(scans, label="spam").collect()
    assert [r["subject"] for r in exp] == ["'=1+1"]
    page, meta = SC.page_of(scans, page=5, page_size=2)
    assert meta == {"total": 3, "page": 2, "pages": 2, "page_size": 2} and [r["id"] for r in page.collect()] == [2]


def test_scan_with_model_scorer(spark):
    from mailsieve.operators import features as FE
    from mailsieve.operators.score import model_scorer
    from mailsieve.operators.train import naive_bayes

    docs = spark.createDataFrame(
        [(i, t, lab) for i, (t, lab) in enumerate([("reset your password now", "phishing"), ("verify your account urgently", "phishing"),
                                                    ("win a free gift voucher", "spam"), ("cheap pills buy now", "spam"),
                                                    ("meeting agenda attached", "safe"), ("invoice for your order attached", "safe")])],
        "doc_id long, body_text string, label string")
    vocab, feats, _ = FE.fit_transform(docs, None)
    w, ic = naive_bayes(feats, docs, vocab)
    batch = docs.select("doc_id", F.concat(F.lit("please "), "body_text").alias("body_text"),
                        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("subject"))
    scans, _ = SC.scan_emails(batch, scorer=model_scorer(vocab, w, ic, ("phishing", "safe", "spam"), {"phishing": 0.5}),
                              created_at=None, model_version="nb-1")
    got = {r["id"]: r for r in scans.collect()}
    assert got[1]["label"] == "phishing" and got[6]["label"] == "safe" and got[4]["label"] == "spam"
    assert got[1]["reasons"] != "" and got[1]["model_version"] == "nb-1"
    assert abs(sum(got[3]["probs"].values()) - 1.0) < 1e-9


def test_near_duplicates_cluster_without_pairs(spark):
    from mailsieve.operators.neardup import drop_near_duplicates, near_duplicate_clusters

    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    rows = [(1, base), (2, base.replace("word30", "changed")), (3, base + " extra"), (4, other), (5, other.upper()),
            (6, "completely different short text about meetings and agendas for the quarter")]
    df = spark.createDataFrame(rows, "doc_id long, body_text string")
    c = {r["doc_id"]: r["cluster"] for r in near_duplicate_clusters(df).collect()}
    assert c[1] == c[2] == c[3] == 1
    assert c[4] == c[5] == 4  # case-insensitive shingles
    assert c[6] == 6
    assert sorted(r["doc_id"] for r in drop_near_duplicates(df).collect()) == [1, 4, 6]


def test_defaults_and_tidy_columns(spark):
    df = spark.createDataFrame([(1, None, None, None)], "id long, label string, confidence double, created_at timestamp")
    r = SC.apply_defaults(df).first()
    assert r["label"] == "safe" and r["confidence"] == 0.5 and r["created_at"] is not None
    c = spark.createDataFrame([("t", "safe", 3, "x")], "body_text string, label string, len_chars int, extra string")
    assert C.tidy_columns(c).columns == ["body_text", "label", "len_chars"]
    assert C.fill_len_chars(c.drop("len_chars")).first()["len_chars"] == 1


def test_dedupe_plan_aggregates_narrow_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("body_text"),
                                  F.lit("safe").alias("label"))
    d = C.dedupe_keep_first(df, "doc_id")
    d.write.format("noop").mode("overwrite").save()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert d.count() == 7


def test_keep_first_with_null_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "k", "c")], "o long, k string, v string")
    assert sorted(r["v"] for r in C.first_per_key(df, ["k"], "o").collect()) == ["a", "c"]


def test_chain_of_bands_is_one_cluster(spark):
    from mailsieve.operators.neardup import clusters_of_bands

    rows = [(i, b) for i in range(60) for b in (i, i + 1)] + [(100, 500)]
    got = {r["doc_id"]: r["cluster"] for r in clusters_of_bands(spark.createDataFrame(rows, "doc_id long, band long")).collect()}
    assert {got[i] for i in range(60)} == {0} and got[100] == 100


def test_components_of_random_graphs(spark):
    import random

    from mailsieve.operators.components import connected_components

    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1000) for i in range(200)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    on_edge = {x for a, b in edges if a != b for x in (a, b)}
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in on_edge}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_split_and_mix_keep_null_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "doc_id long, label string")
    assert M.balanced_mix(df, "doc_id", "label", 10).count() == 5
    assert M.stratified_split(df, "doc_id", "label", 0.5, 42, stratify=True).count() == 5


def test_temperature_beyond_the_first_range(spark):
    # right with odds 3:1, logits apart by 100: the best T is 100 / ln 3, outside of 0.05..20
    rows = [([100.0, 0.0], 0)] * 3 + [([100.0, 0.0], 1)]
    t = M.fit_temperature(spark.createDataFrame(rows, "z array<double>, y int"), "z", "y")
    assert abs(t - 100 / 1.0986) < 1.0


def test_tfidf_shuffles_text_once(spark):
    from mailsieve.operators import features as FE

    docs = spark.createDataFrame([(i, f"alpha beta gamma {i} delta") for i in range(50)], "doc_id long, body_text string")
    vocab = spark.createDataFrame([("word", "alpha", 50, 50, 1.0), ("char", "alp", 50, 50, 1.0)],
                                  "ns string, term string, df long, cf long, idf double")
    f = FE.transform(FE.terms(docs, use_char=True), vocab)
    f.write.format("noop").mode("overwrite").save()
    plan = f._jdf.queryExecution().executedPlan().toString()
    # one by-key repartition of the text; counts and the norm window need no other shuffle
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r["doc_id"], r["ns"]): r["value"] for r in f.collect()}
    assert got[(3, "word")] == 1.0 and got[(3, "char")] == 1.0
