"""Scoring with a linear model over TF-IDF long tables.

Model tables (see ``train``): ``weights(ns, term, label, weight)``,
``intercepts(label, intercept)``, the class list, optional temperature and a
``thresholds(label, tau)`` table.  Weight tables are bounded by the vocabulary
cap (max_features x classes), which is what makes broadcasting them safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.constants import CLASSES, TOP_K_REASONS
from mailsieve.functions.text import _c
from mailsieve.operators.metrics import softmax, temperature_scale


def prob_map(probs, classes) -> Column:
    """Class -> probability."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), _c(probs))


def _first_max(entries: Column) -> Column:
    """First struct with the largest ``prob`` (stable arg-max, F6/F7)."""
    m = F.array_max(F.transform(entries, lambda s: s["prob"]))
    return F.filter(entries, lambda s: s["prob"] == m)[0]


def decide(probs, classes, thresholds) -> Column:
    """Threshold decision record.

    ``thresholds`` is a dict {class: tau} or a ``map<string,double>`` column.
    No thresholds -> arg-max (``no_thresholds_configured``); else the most
    probable class with p >= tau (missing tau = 0) (``passed_threshold``);
    none passes -> arg-max (``no_class_met_threshold``).
    """
    p = _c(probs)
    entries = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("label"), p.alias("prob"))
    entries = F.transform(entries, lambda s: F.struct(s["label"].alias("label"), s["prob"].alias("prob")))
    top = _first_max(entries)
    raw = F.struct(top["label"].alias("label"), top["prob"].alias("prob"))
    if isinstance(thresholds, dict):
        if not thresholds:
            return F.struct(raw.alias("raw_top"), F.create_map().cast("map<string,double>").alias("thresholds_used"),
                            raw.alias("winner"), F.lit("no_thresholds_configured").alias("fallback_reason"))
        tmap = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
        configured = F.lit(True)
    else:
        tmap = _c(thresholds)
        configured = F.coalesce(F.size(tmap) > 0, F.lit(False))
    tau = F.transform(entries, lambda s: F.coalesce(tmap[s["label"]], F.lit(0.0)))
    used = F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), tau)
    passed = F.filter(F.arrays_zip(entries.alias("e"), tau.alias("t")), lambda z: z["e"]["prob"] >= z["t"])
    passed = F.transform(passed, lambda z: z["e"])
    best = _first_max(passed)
    win = F.when(F.size(passed) > 0, F.struct(best["label"].alias("label"), best["prob"].alias("prob"))).otherwise(raw)
    reason = F.when(~configured, F.lit("no_thresholds_configured")).when(F.size(passed) > 0, F.lit("passed_threshold")) \
        .otherwise(F.lit("no_class_met_threshold"))
    return F.struct(raw.alias("raw_top"), F.when(configured, used).otherwise(F.create_map().cast("map<string,double>"))
                    .alias("thresholds_used"), F.when(configured, win).otherwise(raw).alias("winner"), reason.alias("fallback_reason"))


def priority_decision(probs, classes, thresholds: dict) -> Column:
    """Phishing if p >= tau, else spam if p >= tau, else safe."""
    m = prob_map(probs, classes)
    return (F.when(m["phishing"] >= F.lit(float(thresholds.get("phishing", 0.0))), F.lit("phishing"))
            .when(m["spam"] >= F.lit(float(thresholds.get("spam", 0.0))), F.lit("spam")).otherwise(F.lit("safe")))


def thresholds_from_json(df: DataFrame, col: str = "json") -> DataFrame:
    """Metrics JSON text -> one ``map<class, tau>`` per row.

    ``chosen`` wins when numeric, else the largest numeric value of the entry;
    entries that are not objects are skipped; unreadable JSON gives an empty map.
    """
    top = F.from_json(F.col(col), "map<string,string>")
    sug = F.from_json(top["threshold_suggestions"], "map<string,string>")
    per = F.transform_values(sug, lambda k, v: F.from_json(v, "map<string,string>"))
    nums = F.transform_values(per, lambda k, m: F.transform_values(m, lambda kk, vv: vv.try_cast("double")))

    def pick(k, m):
        chosen = m["chosen"]
        vals = F.filter(F.map_values(m), lambda x: x.isNotNull())
        return F.coalesce(chosen, F.array_max(vals))

    chosen = F.transform_values(nums, pick)
    clean = F.map_filter(chosen, lambda k, v: v.isNotNull())
    return df.withColumn("thresholds", F.coalesce(clean, F.create_map().cast("map<string,double>")))


def thresholds_map(thr: DataFrame) -> Column:
    """Small ``thresholds(label, tau)`` table -> a literal map (the table is bounded by the class count)."""
    rows = thr.select("label", "tau").collect()
    if len(rows) > 1000:
        raise ValueError("threshold table is not small")
    return F.create_map(*[x for r in rows for x in (F.lit(r["label"]), F.lit(float(r["tau"])))])


def load_thresholds_from_rows(thr: DataFrame) -> dict:
    rows = thr.select("label", "tau").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("threshold table is not small")
    return {r["label"]: float(r["tau"]) for r in rows}


def weight_arrays(weights: DataFrame, classes) -> DataFrame:
    """(ns, term, w): one row per term, the classes' weights in order."""
    per_class = [F.coalesce(F.max(F.when(F.col("label") == c, F.col("weight"))), F.lit(0.0)) for c in classes]
    return weights.groupBy("ns", "term").agg(F.array(*per_class).alias("w"))


def class_scores(features: DataFrame, weights: DataFrame, key: str = "doc_id", classes=CLASSES) -> DataFrame:
    """Per (doc, label) sum of value x weight, one joined row per feature."""
    j = features.join(F.broadcast(weight_arrays(weights, classes)), ["ns", "term"])
    per = j.groupBy(key).agg(*[F.sum(F.col("value") * F.col("w")[i]).alias(f"__{i}") for i in range(len(classes))])
    return per.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"__{i}").alias("dot"))
                                             for i, c in enumerate(classes)])))


def logits(docs: DataFrame, features: DataFrame, weights: DataFrame, intercepts: dict, classes,
           key: str = "doc_id") -> DataFrame:
    """M10 step 1: logits array (class order) per document, docs without known terms included."""
    j = features.join(F.broadcast(weight_arrays(weights, classes)), ["ns", "term"])
    per = j.groupBy(key).agg(*[F.sum(F.col("value") * F.col("w")[i]).alias(f"__{i}") for i in range(len(classes))])
    arr = F.array(*[F.coalesce(F.col(f"__{i}"), F.lit(0.0)) + F.lit(float(intercepts.get(c, 0.0))) for i, c in enumerate(classes)])
    return docs.select(key).join(per, key, "left").select(key, arr.alias("logits"))


def predict_explained(docs: DataFrame, features: DataFrame, weights: DataFrame, intercepts: dict, classes,
                      thresholds: dict | None = None, temperature: float | None = None, key: str = "doc_id",
                      k: int = TOP_K_REASONS) -> DataFrame:
    """``predict`` and ``reasons`` (as ``top_reasons`` for the arg-max class) from one pass over the features.

    A document's in-vocabulary terms meet in one row, with their contributions to every class.
    """
    j = features.join(F.broadcast(weight_arrays(weights, classes)), ["ns", "term"])
    one = F.struct("ns", "term", F.transform("w", lambda x: x * F.col("value")).alias("c"))
    per = j.groupBy(key).agg(F.collect_list(one).alias("__t"))

    def score(i: int, c: str) -> Column:
        total = F.aggregate("__t", F.lit(0.0), lambda acc, t: acc + t["c"][i])
        return F.coalesce(total, F.lit(0.0)) + F.lit(float(intercepts.get(c, 0.0)))

    x = docs.select(key).join(per, key, "left").withColumn("logits", F.array(*[score(i, c) for i, c in enumerate(classes)]))
    x = x.withColumn("probs", softmax(temperature_scale(F.col("logits"), temperature) if temperature else F.col("logits")))
    top = F.array_position("probs", F.array_max("probs")).cast("int")
    ranked = F.array_sort(F.transform("__t", lambda t: F.struct(
        (-F.round(F.element_at(t["c"], top), 9)).alias("order"), t["ns"].alias("ns"), t["term"].alias("token"),
        F.element_at(t["c"], top).alias("weight"))))
    reasons = F.transform(F.slice(F.filter(ranked, lambda r: r["weight"] > 0), 1, k),
                          lambda r: F.struct(r["token"].alias("token"), r["weight"].alias("weight"), r["ns"].alias("ns")))
    x = x.withColumn("reasons", F.coalesce(reasons, F.array().cast("array<struct<token:string,weight:double,ns:string>>")))
    d = decide(F.col("probs"), classes, thresholds or {})
    return x.select(key, "logits", "probs", prob_map(F.col("probs"), classes).alias("prob_map"), d.alias("decision"), "reasons") \
        .withColumn("label", F.col("decision.winner.label")).withColumn("confidence", F.col("decision.winner.prob"))


def predict(docs: DataFrame, features: DataFrame, weights: DataFrame, intercepts: dict, classes,
            thresholds: dict | None = None, temperature: float | None = None, key: str = "doc_id") -> DataFrame:
    """M10 + M11 + H25: logits -> (temperature) -> softmax -> decision and probability map."""
    lg = logits(docs, features, weights, intercepts, classes, key)
    z = temperature_scale(F.col("logits"), temperature) if temperature else F.col("logits")
    p = lg.withColumn("probs", softmax(z))
    d = decide(F.col("probs"), classes, thresholds or {})
    return p.select(key, "logits", "probs", prob_map(F.col("probs"), classes).alias("prob_map"), d.alias("decision")) \
        .withColumn("label", F.col("decision.winner.label")).withColumn("confidence", F.col("decision.winner.prob"))


def top_reasons(features: DataFrame, weights: DataFrame, chosen: DataFrame, key: str = "doc_id",
                k: int = TOP_K_REASONS, binary_negative: str | None = None) -> DataFrame:
    """The k largest positive value x weight terms of each document's chosen class.

    ``chosen`` is (key, label).  Per-document groups are bounded by the number
    of distinct vocabulary terms in one document (the vocabulary cap).  For a
    one-row binary model pass ``binary_negative``: that class uses the negated
    weights (the single stored row explains the positive class only).
    """
    w = weights
    if binary_negative is not None:
        pos = w.select("ns", "term", "weight")
        w = w.unionByName(pos.select("ns", "term", F.lit(binary_negative).alias("label"), (-F.col("weight")).alias("weight")))
    j = features.join(chosen.select(key, "label"), key).join(F.broadcast(w), ["ns", "term", "label"])
    c = j.select(key, "ns", "term", (F.col("value") * F.col("weight")).alias("contribution")).where(F.col("contribution") > 0)
    # contributions equal to 9 decimals count as ties (summation order may differ
    # in the last bits between runs); ties go to namespace, then term
    win = Window.partitionBy(key).orderBy(F.desc(F.round("contribution", 9)), F.asc("ns"), F.asc("term"))
    top = c.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)
    agg = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term", "contribution", "ns"))).alias("r"))
    reasons = F.transform(F.col("r"), lambda s: F.struct(s["term"].alias("token"), s["contribution"].alias("weight"),
                                                         s["ns"].alias("ns")))
    return chosen.select(key).join(agg.select(key, reasons.alias("reasons")), key, "left") \
        .withColumn("reasons", F.coalesce("reasons", F.array().cast("array<struct<token:string,weight:double,ns:string>>")))


def model_scorer(vocab: DataFrame, weights: DataFrame, intercepts: dict, classes, thresholds: dict | None = None,
                 temperature: float | None = None, k: int = TOP_K_REASONS):
    """M5 with a model: a scorer for ``scans.scan_emails`` (email_id, body_text) -> label,
    confidence, reasons_list (top-k tokens and weights of the raw arg-max class), decision, probs.

    The vocabulary and weights are bounded by the vocabulary cap (broadcast);
    documents are tokenised once.
    """
    from mailsieve.operators import features as FE

    def score(emails: DataFrame) -> DataFrame:
        docs = emails.select(F.col("email_id"), F.col("body_text"))
        use_char = not vocab.where(F.col("ns") == "char").isEmpty()
        feats = FE.transform_texts(docs, vocab, "email_id", "body_text", use_char)
        p = predict_explained(docs.select("email_id"), feats, weights, intercepts, classes, thresholds, temperature, "email_id", k)
        return p.select("email_id", "label", F.col("confidence").cast("double").alias("confidence"),
                        F.transform("reasons", lambda s: F.struct(s["token"].alias("token"), s["weight"].alias("weight"))).alias("reasons_list"),
                        "decision", F.col("prob_map").alias("probs"))

    return score
