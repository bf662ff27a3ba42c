"""Training jobs.

Two linear models share one output format -- ``weights(ns, term, label, weight)``
and ``{label: intercept}`` -- so ``score.predict`` serves both:

* ``naive_bayes``: multinomial NB over TF-IDF values.  Its fit is a pair of
  aggregates, so it is exact and checkable against SQL.  Weights are stored
  centred per term (minus the mean over classes), which leaves the softmax
  unchanged and gives signed, explainable contributions.
* ``logistic_regression``: Spark ML multinomial logistic regression with
  balanced sample weights (the trainer's class-weighted softmax regression);
  candidates over ``regParam`` are chosen on the validation split (E3).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.constants import CLASSES, PRECISION_TARGET, SPLIT_SEED, VAL_SIZE
from mailsieve.operators import features as FE
from mailsieve.operators import metrics as M
from mailsieve.operators.corpus import binary_label, training_rows
from mailsieve.session import checkpoint_dir


def label_index(classes) -> dict:
    """M7: alphabetical label encoding."""
    return {c: i for i, c in enumerate(sorted(classes))}


def naive_bayes(features: DataFrame, labels: DataFrame, vocab: DataFrame, classes=CLASSES, alpha: float = 1.0,
                key: str = "doc_id", tasks: int | None = None) -> tuple[DataFrame, dict]:
    """Multinomial NB on TF-IDF values -> (centred weights, intercepts).

    ``tasks``: of the join with the labels, so that the features a task sorts do not grow with the table (see ``features.size_of``).
    The sums, one row per term and class at most, are written once: the features are made for them only.
    """
    checkpoint_dir(features.sparkSession)
    f = (features.repartition(tasks, key) if tasks else features).join(labels.select(key, "label"), key)
    sums = f.groupBy("ns", "term", "label").agg(F.sum("value").alias("s")).checkpoint()
    tot = sums.groupBy("label").agg(F.sum("s").alias("t"))
    v_size = vocab.count()
    grid = vocab.select("ns", "term", F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    # `tot` has one row per class: a proven bound for the broadcast.
    g = grid.join(sums, ["ns", "term", "label"], "left").join(F.broadcast(tot), "label", "left")
    lp = F.log((F.coalesce("s", F.lit(0.0)) + F.lit(alpha)) / (F.coalesce("t", F.lit(0.0)) + F.lit(alpha * v_size)))
    g = g.withColumn("lp", lp)
    centred = g.withColumn("weight", F.col("lp") - F.avg("lp").over(Window.partitionBy("ns", "term")))
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    intercepts = {c: math.log(counts[c] / n) if counts.get(c) else -1e9 for c in classes}
    return centred.select("ns", "term", "label", "weight"), intercepts


def with_label_index(df: DataFrame, label: str = "label", out: str = "label_idx") -> DataFrame:
    """M7 over a column: 0-based alphabetical index of every label present (null labels: null)."""
    names = df.select(label).distinct().where(F.col(label).isNotNull())
    index = names.select(F.col(label).alias("__label"), (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias(out))
    return df.join(index, F.col(label) == F.col("__label"), "left").drop("__label")


#: largest Poisson mean that is drawn at once, and the count that it practically never passes (1e-16)
POISSON_MEAN, POISSON_MAX = 16, 60


def _hash_share(*parts) -> Column:
    """A number in [0, 1) from the MD5 of the joined parts."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(mean) -> Column:
    """P(X <= k) for k = 0..POISSON_MAX."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(POISSON_MAX)), start, step, lambda s: s["cdf"])


def _draws(df: DataFrame, key: str, label: str, seed: int, mean_total: float) -> DataFrame:
    """(key, draw): independent Poisson numbers of draws, ``mean_total`` on average, classes alike."""
    per = df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__c"))
    mean = F.lit(mean_total) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("__c"))
    per = per.select("__label", mean.alias("__mean")).withColumn("__pieces", F.ceil(F.col("__mean") / POISSON_MEAN).cast("int"))
    # one row a class
    per = per.select("__label", "__pieces", poisson_cdf(F.col("__mean") / F.col("__pieces")).alias("__cdf"))
    x = df.select(F.col(key).alias("__key"), F.col(label).alias("__l")).where(F.col("__key").isNotNull())
    x = x.join(F.broadcast(per), F.col("__l").eqNullSafe(F.col("__label")))
    x = x.select("__key", "__cdf", F.explode(F.sequence(F.lit(1), F.col("__pieces"))).alias("__piece"))
    x = x.withColumn("__u", _hash_share(seed, F.col("__key").cast("string"), F.col("__piece").cast("string")))
    n = F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    x = x.select("__key", "__piece", n.alias("__n")).where("__n > 0")
    x = x.select("__key", "__piece", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"))
    return x.select(F.col("__key").alias("__from"), F.concat_ws(":", F.col("__key").cast("string"), F.col("__piece").cast("string"),
                                                                F.col("__i").cast("string")).alias("__draw"))


def resample_margin(n: int) -> float:
    """Mean number of draws from which ``n`` are kept: six standard deviations more."""
    return n + 6 * math.sqrt(n) + 12


def weighted_resample(df: DataFrame, key: str = "doc_id", label: str = "label", seed: int = SPLIT_SEED, n: int | None = None) -> DataFrame:
    """``n`` rows (all if not given) drawn with replacement, a row with weight 1 / rows of its class.

    Every row is drawn a Poisson number of times (inverse CDF of a hash of seed, key and piece; a mean above POISSON_MEAN is the
    sum of several pieces), somewhat more than ``n`` in all, and the ``n`` draws of the smallest hash stay: given their
    number, Poisson draws are draws with replacement.  No row meets another one but in the trim, which ranks narrow draws in
    buckets of their hash.  The result depends on seed and keys only.  Keys are unique; rows without a key are not drawn.
    """
    checkpoint_dir(df.sparkSession)
    n = df.count() if n is None else n
    mean = resample_margin(n)
    while True:
        draws = _draws(df, key, label, seed, mean).checkpoint()
        total = draws.count()
        if total >= n or total == 0:
            break
        mean += n  # one run in a thousand million
    kept = M.hash_rank(draws, "__draw", [], seed).where(F.col("__rank") <= n).select("__from")
    return df.join(kept, F.col(key) == F.col("__from")).drop("__from")


def logistic_regression(train_vec: DataFrame, index: DataFrame, classes=CLASSES, reg_param: float = 1e-4,
                        max_iter: int = 100, weight_col: str | None = "weight"):
    """M9: Spark ML multinomial LR -> (model, weights table, intercepts)."""
    from pyspark.ml.classification import LogisticRegression

    cls_idx = label_index(classes)
    m = F.create_map(*[x for c, i in cls_idx.items() for x in (F.lit(c), F.lit(float(i)))])
    data = train_vec.withColumn("y", m[F.col("label")])
    lr = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=reg_param,
                            elasticNetParam=0.0, maxIter=max_iter, standardization=False)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    model = lr.fit(data)
    coef = model.coefficientMatrix.toArray()  # k x d, bounded by the vocabulary cap
    spark = train_vec.sparkSession
    import pandas as pd

    idx = index.toPandas().sort_values("idx")
    frames = []
    for c, i in cls_idx.items():
        frames.append(pd.DataFrame({"ns": idx["ns"].values, "term": idx["term"].values, "label": c,
                                    "weight": coef[i][idx["idx"].values]}))
    wt = spark.createDataFrame(pd.concat(frames), "ns string, term string, label string, weight double")
    intercepts = {c: float(model.interceptVector[i]) for c, i in cls_idx.items()}
    return model, wt, intercepts


def train_job(corpus: DataFrame, *, binary: bool = False, use_char: bool = False, val_size: float = VAL_SIZE,
              seed: int = SPLIT_SEED, reg_params=(1e-4, 1e-3, 1e-2), calibrate: bool = False,
              max_features: dict | None = None, model: str = "logreg", key: str = "doc_id",
              text: str = "body_text") -> dict:
    """The trainer end to end.  Returns a dict of DataFrames and small scalars (the model format)."""
    from mailsieve.operators.score import predict

    rows = training_rows(corpus, text, "label")
    if binary:
        rows = rows.withColumn("label", binary_label("label"))
    classes = sorted(r["label"] for r in rows.select("label").distinct().collect())
    split = M.stratified_split(rows.select(key, text, "label"), key, "label", val_size, seed).cache()
    tr = split.where(F.col("split") == "train")
    va = split.where(F.col("split") == "val")
    vocab, f_tr, f_va = FE.fit_transform(tr, va, key, text, use_char, max_features)
    vocab = vocab.cache()
    cw = M.class_weights(tr, "label", "balanced")
    if model == "nb":
        weights, intercepts = naive_bayes(f_tr, tr, vocab, classes, key=key, tasks=FE.size_of(tr, text)[1])
        best = {"reg_param": None}
    else:
        index = FE.feature_index(vocab).cache()
        size = index.count()
        # every fit and every candidate's scores read what is written here once: the texts are not counted again
        vec_tr = FE.to_vectors(f_tr, index, size, key).join(M.with_sample_weight(tr, cw), key).select("label", "features", "weight").checkpoint()
        f_va = f_va.checkpoint()
        candidates = []
        for rp in reg_params:
            _, wt, ic = logistic_regression(vec_tr, index, classes, rp)
            pv = predict(va.select(key), f_va, wt, ic, classes, key=key).join(va.select(key, "label").withColumnRenamed("label", "y"), key)
            if binary:
                ev = pv.select((F.col("y") == "not_safe").cast("int").alias("y"),
                               F.col("prob_map")["not_safe"].alias("p"))
                thr = M.tune_threshold(ev, "p", "y", "f2").first()["threshold"]
                score = M.binary_fbeta_at(ev, "p", "y", thr, 2.0).first()["fbeta"]
            else:
                score = M.macro_recall(pv, "y", "label", classes).first()["macro_recall"]
            candidates.append((score, rp, wt, ic))
        best_score = max(c[0] for c in candidates)
        score, rp, weights, intercepts = next(c for c in candidates if c[0] == best_score)  # earliest on ties
        best = {"reg_param": rp, "selection_score": score}
    pv = predict(va.select(key), f_va, weights, intercepts, classes, key=key)
    temperature = None
    if calibrate:
        lab_idx = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
        cal = pv.join(va.select(key, "label"), key).withColumn("label_idx", lab_idx[F.col("label")])
        temperature = M.fit_temperature(cal, "logits", "label_idx")
        pv = predict(va.select(key), f_va, weights, intercepts, classes, temperature=temperature, key=key)
    ev = pv.select(key, F.col("label").alias("pred"), "prob_map").join(va.select(key, "label"), key).checkpoint()
    tuned = None
    if binary:
        b = ev.select((F.col("label") == "not_safe").cast("int").alias("y"), F.col("prob_map")["not_safe"].alias("p"))
        tuned = M.tune_threshold(b, "p", "y", "recall", PRECISION_TARGET).first()["threshold"]
        ev = ev.withColumn("pred", F.when(F.col("prob_map")["not_safe"] >= tuned, "not_safe").otherwise("safe"))
        report_classes = ["safe", "not_safe"]
    else:
        report_classes = classes
    record = M.run_record(
        ev, "label", "pred", report_classes, class_counts=rows, inputs={"corpus": rows.select(key, text, "label")}, temperature=temperature,
        tuned_threshold=tuned, best_score=best.get("selection_score"),
        params={"model": model, "binary": binary, "use_char": use_char, "val_size": val_size, "seed": seed, "calibrate": calibrate,
                "reg_param": best["reg_param"], "max_features": json.dumps(max_features)})
    return {
        "record": record, "classes": classes, "vocab": vocab, "weights": weights, "intercepts": intercepts,
        "temperature": temperature, "tuned_threshold": tuned, "best": best,
        "report": M.classification_report(ev, "label", "pred", report_classes),
        "confusion": M.confusion_matrix(ev, "label", "pred", report_classes),
        "accuracy": M.accuracy(ev, "label", "pred"),
        "class_counts": rows.groupBy("label").count(),
        "val_predictions": ev,
    }


def save_model(result: dict, path: str, version: str = "model") -> None:
    """Model tables as Parquet plus one JSON metadata row."""
    spark = result["weights"].sparkSession
    result["vocab"].write.mode("overwrite").parquet(f"{path}/vocab")
    result["weights"].write.mode("overwrite").parquet(f"{path}/weights")
    meta = {
        "version": version, "classes": result["classes"], "intercepts": result["intercepts"],
        "temperature": result["temperature"], "tuned_threshold": result["tuned_threshold"],
        "best": {k: v for k, v in result["best"].items()},
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/meta")
    result["report"].write.mode("overwrite").json(f"{path}/report")
    result["confusion"].write.mode("overwrite").json(f"{path}/confusion")
    if "record" in result:
        result["record"].write.mode("overwrite").json(f"{path}/record")


def load_model(spark, path: str) -> dict:
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    return {"vocab": spark.read.parquet(f"{path}/vocab"), "weights": spark.read.parquet(f"{path}/weights"), **meta}
