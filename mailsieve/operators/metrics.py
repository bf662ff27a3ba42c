"""Evaluation metrics as aggregates.

Scale notes
* Classification metrics are one conditional-aggregate pass (partial
  aggregation on every map task, a one-row result), then reshaped.
* Curve tables need running sums in score order.  An unpartitioned window
  would pull every row into one task, so ``cumulative_counts``:
    1. reduces to one row per distinct score (combinable aggregate), written once;
    2. sketches their quantiles and cuts them into ``n_buckets`` ranges of about equally many
       distinct scores, wherever the scores lie (uniform, saturated or all the same);
    3. prefix-sums the bucket totals (a window over at most ``n_buckets`` rows) and
       joins the offsets back on the bucket key;
    4. runs the per-bucket window and adds the offset.
* Stratified split uses hash buckets per label, never one
  window per label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.text import _c
from mailsieve.operators.ranges import quantile_bounds, range_of
from mailsieve.session import checkpoint_dir

N_BUCKETS = 1024
SEED_DEFAULT = 42


# --- classification -----------------------------------------------------------

def _cond_counts(df: DataFrame, label: str, pred: str, classes) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(pred)).alias("n_correct")]
    for i, c in enumerate(classes):
        aggs += [F.count_if(F.col(label) == c).alias(f"s{i}"), F.count_if(F.col(pred) == c).alias(f"p{i}"),
                 F.count_if((F.col(label) == c) & (F.col(pred) == c)).alias(f"t{i}")]
    return df.agg(*aggs)


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def fbeta(prec, rec, beta: float) -> Column:
    """(1+b^2)PR / max(b^2 P + R, 1e-12); 0 when P+R = 0."""
    p, r = _c(prec), _c(rec)
    b2 = float(beta) * float(beta)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(
        F.lit(1.0 + b2) * (p * r) / F.greatest(F.lit(b2) * p + r, F.lit(1e-12)))


def per_class_stats(df: DataFrame, label: str, pred: str, classes) -> DataFrame:
    """Rows (class, tp, support, predicted, n, n_correct) from one aggregate pass."""
    c = _cond_counts(df, label, pred, classes)
    rows = F.array(*[F.struct(F.lit(cl).alias("class"), F.col(f"t{i}").alias("tp"), F.col(f"s{i}").alias("support"),
                              F.col(f"p{i}").alias("predicted")) for i, cl in enumerate(classes)])
    return c.select("n", "n_correct", F.inline(rows))


def classification_report(df: DataFrame, label: str, pred: str, classes) -> DataFrame:
    """precision/recall/f1/support per class, then accuracy, macro avg, weighted avg rows."""
    s = per_class_stats(df, label, pred, classes)
    per = s.select(
        "class", "n", "n_correct",
        _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
        _safe_div(F.col("tp"), F.col("support")).alias("recall"),
        F.col("support"),
    ).withColumn("f1", fbeta("precision", "recall", 1.0))
    k = len(classes)
    # all rows of `per` come from one aggregate row, so the roll-up below is an
    # aggregate over k rows.
    summary = per.agg(
        F.first("n").alias("n"), F.first("n_correct").alias("n_correct"),
        (F.sum("precision") / k).alias("mp"), (F.sum("recall") / k).alias("mr"), (F.sum("f1") / k).alias("mf"),
        _safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
    )
    t = "struct<class:string,precision:double,recall:double,f1:double,support:bigint>"

    def row(name, p, r, f, n):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), n.cast("long").alias("support")).cast(t)

    nul = F.lit(None).cast("double")
    extra = summary.select(F.inline(F.array(
        row("accuracy", nul, nul, _safe_div(F.col("n_correct"), F.col("n")), F.col("n")),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf"), F.col("n")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf"), F.col("n")),
    )))
    return per.select("class", "precision", "recall", "f1", "support").unionByName(extra)


def confusion_matrix(df: DataFrame, label: str, pred: str, classes) -> DataFrame:
    """One row per true class, one count column per predicted class (zero-filled)."""
    aggs = [F.count_if((F.col(label) == a) & (F.col(pred) == b)).alias(f"c_{i}_{j}")
            for i, a in enumerate(classes) for j, b in enumerate(classes)]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("label"), *[F.col(f"c_{i}_{j}").alias(b) for j, b in enumerate(classes)])
                     for i, a in enumerate(classes)])
    return one.select(F.inline(rows))


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """D12"""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def macro_recall(df: DataFrame, label: str, pred: str, classes) -> DataFrame:
    """Mean per-class recall over the classes."""
    s = per_class_stats(df, label, pred, classes)
    return s.agg((F.sum(_safe_div(F.col("tp"), F.col("support"))) / len(classes)).alias("macro_recall"))


# --- the record of a training run (M18, A18) ---------------------------------------

def content_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``rows:sum``, the sum of 32-bit row hashes (MD5 of the values as text), whatever the order and the files."""
    one = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns or df.columns])
    h = F.conv(F.substring(F.md5(one), 1, 8), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total.cast("string")).alias("fingerprint"))


def run_record(evaluated: DataFrame, label: str, pred: str, classes, *, class_counts: DataFrame | None = None,
               inputs: dict[str, DataFrame] | None = None, params: dict | None = None, temperature: float | None = None,
               tuned_threshold: float | None = None, best_score: float | None = None) -> DataFrame:
    """One row that tells a run: classes, class counts, report, confusion matrix, accuracy, T, threshold, input fingerprints, params.

    Every part is a small aggregate (a row a class) that enters as a scalar.
    """
    spark = evaluated.sparkSession
    report = classification_report(evaluated, label, pred, classes).agg(F.collect_list(F.struct("class", "precision", "recall", "f1", "support")).alias("x"))
    matrix = confusion_matrix(evaluated, label, pred, classes).select("label", F.array(*[F.col(f"`{c}`") for c in classes]).alias("predicted"))
    counts = (evaluated if class_counts is None else class_counts).where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n")))).alias("x"))
    prints = [x for name, df in (inputs or {}).items() for x in (F.lit(name), content_fingerprint(df).scalar())]
    settings = [x for name, v in (params or {}).items() for x in (F.lit(name), F.lit(str(v)))]
    text_map = "map<string,string>"
    number = [F.lit(v).cast("double").alias(n) for n, v in (("temperature", temperature), ("tuned_threshold", tuned_threshold), ("best_score", best_score))]
    return spark.range(1).select(
        F.array(*[F.lit(c) for c in classes]).alias("classes"), counts.scalar().alias("class_counts"), report.scalar().alias("report"),
        matrix.agg(F.collect_list(F.struct("label", "predicted")).alias("x")).scalar().alias("confusion_matrix"),
        accuracy(evaluated, label, pred).scalar().alias("accuracy"), *number,
        (F.create_map(*prints) if prints else F.create_map().cast(text_map)).alias("inputs"),
        (F.create_map(*settings) if settings else F.create_map().cast(text_map)).alias("params"), F.current_timestamp().alias("trained_at"))


# --- class weights ---------------------------------------------------------------

def class_weights(df: DataFrame, label: str = "label", mode: str = "balanced") -> DataFrame:
    """D7 ``n / (k * n_c)`` (balanced) or D8 ``1 / n_c`` (inverse) per label.

    The per-label table is tiny (one row per class); totals come from a window
    over that table, not from a join.
    """
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    if mode == "balanced":
        weight = F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))
    elif mode == "inverse":
        weight = F.lit(1.0) / F.greatest(F.col("n_c"), F.lit(1))
    else:
        raise ValueError(mode)
    return cnt.withColumn("weight", weight.cast("double"))


def with_sample_weight(df: DataFrame, weights: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach the per-label weight; the weight table has one row per class (broadcast)."""
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias(out))), label, "left")


# --- curves -------------------------------------------------------------------------

def score_counts(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((F.lit(1) - F.col(y)).cast("long")).alias("neg"))


def bucketed_counts(df: DataFrame, score: str, y: str, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``score_counts`` with an order-preserving ``bucket`` of about equally many distinct scores (null scores: the lowest)."""
    checkpoint_dir(df.sparkSession)
    counts = score_counts(df, score, y).checkpoint()
    bounds = quantile_bounds(counts, "score", n_buckets)
    # a bound is the greatest score of its range
    return counts.withColumn("bounds", bounds).withColumn("bucket", range_of(F.col("score"), F.col("bounds"), n_buckets)).drop("bounds")


def cumulative_counts(df: DataFrame, score: str, y: str, n_buckets: int = N_BUCKETS) -> DataFrame:
    """For each distinct score s: tp/fp = positives/negatives with score >= s,
    plus totals P and N and the score's own pos and neg on every row.  See the module notes for the plan shape."""
    sc = bucketed_counts(df, score, y, n_buckets)
    tot = sc.groupBy("bucket").agg(F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"))
    wall = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    wtot = Window.partitionBy()
    offs = tot.select(
        "bucket",
        F.coalesce(F.sum("b_pos").over(wall), F.lit(0)).alias("off_pos"),
        F.coalesce(F.sum("b_neg").over(wall), F.lit(0)).alias("off_neg"),
        F.sum("b_pos").over(wtot).alias("P"),
        F.sum("b_neg").over(wtot).alias("N"),
    )
    # `offs` has at most n_buckets rows by construction: a proven bound.
    j = sc.join(F.broadcast(offs), "bucket")
    wb = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        "score",
        (F.col("off_pos") + F.sum("pos").over(wb)).alias("tp"),
        (F.col("off_neg") + F.sum("neg").over(wb)).alias("fp"),
        "P", "N", "pos", "neg",
    )


def pr_curve(df: DataFrame, score: str, y: str) -> DataFrame:
    """(threshold, precision, recall, tp, fp) at each distinct score.

    Recall is 1 everywhere when there are no positives (library convention).
    The final (P=1, R=0) point is added by ``tune_threshold``.
    """
    c = cumulative_counts(df, score, y)
    return c.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("P")).alias("recall"),
        "tp", "fp", "P", "N",
    )


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    """Sum over thresholds (descending) of (R_n - R_(n-1)) * P_n.

    R_(n-1) is recall at the next higher score, i.e. (tp - pos at this score)/P;
    written that way the sum needs no ordered ``lag``.
    """
    j = cumulative_counts(df, score, y)
    term = F.when(F.col("P") == 0, F.lit(0.0)).otherwise(
        (F.col("pos") / F.col("P")) * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return j.agg(F.sum(term).alias("average_precision"))


def roc_points(df: DataFrame, score: str, y: str) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score (all points kept)."""
    c = cumulative_counts(df, score, y)
    return c.select(
        F.col("score").alias("threshold"),
        F.when(F.col("N") == 0, F.lit(float("nan"))).otherwise(F.col("fp") / F.col("N")).alias("fpr"),
        F.when(F.col("P") == 0, F.lit(float("nan"))).otherwise(F.col("tp") / F.col("P")).alias("tpr"),
    )


def roc_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Trapezoid area; ties share a segment.  Previous point = counts above this score."""
    j = cumulative_counts(df, score, y)
    prev_tp = F.col("tp") - F.col("pos")
    prev_fp = F.col("fp") - F.col("neg")
    area = (F.col("fp") - prev_fp) * (F.col("tp") + prev_tp) / F.lit(2.0)
    return j.agg((F.sum(area) / (F.first("P") * F.first("N"))).alias("roc_auc"))


def best_candidate(df: DataFrame, score: str, order: str, ascending_order: bool = True) -> DataFrame:
    """Highest score; ties go to the first candidate in ``order`` (a top-1 sort, TakeOrdered)."""
    o = F.asc(order) if ascending_order else F.desc(order)
    return df.orderBy(F.desc(score), o).limit(1)


def tune_threshold(df: DataFrame, score: str, y: str, metric: str = "f1",
                   precision_target: float | None = None) -> DataFrame:
    """Best threshold for f1 / f2 / f0.5 / recall (at precision >= target) / precision."""
    return tune_on_curve(pr_curve(df, score, y), metric, precision_target)


def tune_on_curve(curve: DataFrame, metric: str = "f1", precision_target: float | None = None) -> DataFrame:
    """M14 over a PR curve (one row per distinct score), so several metrics can share it.

    Candidates are the points and an appended (precision 1, recall 0, threshold 1.0) one, visited in
    increasing threshold order with a strict ``>``, so ties keep the lowest threshold (the appended point comes last).
    When no candidate qualifies the answer is the initial 0.5.
    """
    one = curve.sparkSession.range(1)
    last = one.select(F.lit(1.0).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(1).alias("final"))
    cand = curve.select("threshold", "precision", "recall", F.lit(0).alias("final")).unionByName(last)
    p, r = F.col("precision"), F.col("recall")
    if metric in ("f1", "f2", "f0.5"):
        s = fbeta(p, r, {"f1": 1.0, "f2": 2.0, "f0.5": 0.5}[metric])
    elif metric == "recall":
        s = r
        if precision_target is not None:
            cand = cand.where(p >= precision_target)
    elif metric == "precision":
        s = p
    else:
        s = fbeta(p, r, 1.0)
    scored = cand.withColumn("metric_score", s)
    best = scored.orderBy(F.desc("metric_score"), F.asc("final"), F.asc("threshold")).limit(1)
    fallback = one.select(F.lit(0.5).alias("threshold"), F.lit(-1.0).alias("metric_score"))
    both = best.select("threshold", "metric_score").unionByName(fallback)
    return both.orderBy(F.desc("metric_score")).limit(1).select(F.lit(metric).alias("metric"), "threshold", "metric_score")


def binary_fbeta_at(df: DataFrame, score: str, y: str, threshold: Column | float, beta: float) -> DataFrame:
    """F-beta of ``score >= threshold`` against y (used by the selection score M15)."""
    pred = (F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(threshold))).cast("int")
    c = df.agg(F.count_if((pred == 1) & (F.col(y) == 1)).alias("tp"), F.count_if(pred == 1).alias("pp"),
               F.count_if(F.col(y) == 1).alias("ap"))
    prec = _safe_div(F.col("tp"), F.col("pp"))
    rec = _safe_div(F.col("tp"), F.col("ap"))
    return c.select(fbeta(prec, rec, beta).alias("fbeta"))


# --- probabilities ------------------------------------------------------------------

def softmax(logits: Column) -> Column:
    """H20 over an array column: exp(z - max) / sum(exp(z - max))."""
    z = _c(logits)
    m = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def temperature_scale(logits: Column, t) -> Column:
    """Z / max(T, 1e-6)."""
    tt = F.greatest(t if isinstance(t, Column) else F.lit(float(t)), F.lit(1e-6))
    return F.transform(_c(logits), lambda v: v / tt)


def cross_entropy(df: DataFrame, probs: str, label_idx: str, weight: str | None = None) -> DataFrame:
    """Mean of -ln p[label] (weighted mean when ``weight`` is given)."""
    nll = -F.log(F.element_at(F.col(probs), F.col(label_idx) + 1))
    if weight is None:
        return df.agg(F.avg(nll).alias("cross_entropy"))
    return df.agg((F.sum(F.col(weight) * nll) / F.sum(weight)).alias("cross_entropy"))


def temperature_grid_nll(df: DataFrame, logits: str, label_idx: str, temps) -> DataFrame:
    """M13 one round: NLL of every candidate T in a single pass (rows x candidates, aggregated)."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in temps])).alias("T")
    x = df.select(logits, label_idx, t)
    # log-sum-exp, so that a probability too small for a double still counts
    z = temperature_scale(F.col(logits), F.col("T"))
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return x.groupBy("T").agg(F.avg(F.log(total) + top - F.element_at(z, F.col(label_idx) + 1)).alias("nll"))


def temperature_slopes(df: DataFrame, logits: str, label_idx: str, log_t: float) -> tuple[float, float]:
    """First and second derivative of the mean NLL in log T, from one aggregate over the rows."""
    s = math.exp(-log_t)
    p = F.get(F.transform(F.array(F.transform(F.col(logits), lambda z: z * s)), softmax), F.lit(0))
    mean = F.aggregate(F.zip_with("p", logits, lambda a, z: a * z), F.lit(0.0), lambda acc, x: acc + x)
    square = F.aggregate(F.zip_with("p", logits, lambda a, z: a * z * z), F.lit(0.0), lambda acc, x: acc + x)
    x = df.select(logits, label_idx, p.alias("p")).select(
        mean.alias("m"), square.alias("q"), F.element_at(F.col(logits), F.col(label_idx) + 1).alias("own"))
    one, two = x.agg(F.avg(F.col("m") - F.col("own")), F.avg(F.col("q") - F.col("m") * F.col("m"))).first()
    # d/ds of the NLL is ``one``, d2/ds2 is ``two``; s = exp(-log T)
    return (0.0, 0.0) if one is None else (-s * one, s * s * two + s * one)


def fit_temperature(df: DataFrame, logits: str, label_idx: str, tolerance: float = 1e-10) -> float:
    """The T that minimises the validation NLL, by Newton steps in log T.

    Every step is one aggregate of two numbers.  The sign of the slope keeps a bracket (the NLL is convex in 1/T); a step that
    leaves it, or that the curvature doesn't allow, halves the bracket instead.  Without a minimum inside 1e-6..1e12 the
    nearer end is returned, or the first T at which the slope is 0 in doubles; without rows T is 1.
    """
    low, high, t = math.log(1e-6), math.log(1e12), 0.0
    while high - low > tolerance:
        one, two = temperature_slopes(df, logits, label_idx, t)
        if one == 0.0:
            break
        low, high = (low, t) if one > 0 else (t, high)
        new = t - one / two if two > 0 else math.inf
        if not low < new < high:
            new = (low + high) / 2
        if abs(new - t) <= tolerance:
            t = new
            break
        t = new
    return math.exp(t)


# --- split ----------------------------------------------------------------------------

def hash_rank(df: DataFrame, key: str, group: list[str], seed: int = SEED_DEFAULT, narrow: DataFrame | None = None) -> DataFrame:
    """Rank rows inside ``group`` by md5("seed:key") (ties by key), plus the group size.

    Narrow rows (group, key) are ranked bucket by bucket: counts per (group, first 3 hex
    digits) give each bucket's offset, a window ranks inside it, so a group holding most
    rows is spread over 4,096 buckets.  Rows join their rank by key; null labels are a group.
    Adds ``__rank`` and ``__n``.  ``key`` is unique and not null.  ``narrow``: key and group of the same rows, if written before.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    x = (df if narrow is None else narrow).select(F.col(key).alias("__key"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], h.alias("__h"))
    x = x.withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    by = [f"__g{i}" for i in range(len(group))]
    cnt = x.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__nb"))
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = cnt.select(*[F.col(g).alias(f"_{g}") for g in by], F.col("__b").alias("___b"),
                      F.coalesce(F.sum("__nb").over(w), F.lit(0)).alias("__off"),
                      F.sum("__nb").over(Window.partitionBy(*by)).alias("__n"))
    same = F.col("__b") == F.col("___b")
    for g in by:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", "__key"))
    ranked = x.withColumn("__in", inside).join(offs, same).select("__key", (F.col("__off") + F.col("__in")).alias("__rank"), "__n")
    return df.join(ranked, F.col(key) == F.col("__key")).drop("__key")


def stratified_split(df: DataFrame, key: str, label: str = "label", val_size: float = 0.2, seed: int = 42,
                     stratify: bool | None = None) -> DataFrame:
    """M6: adds ``split`` in {train, val}.

    Rows are ranked inside their label by md5("seed:key"); the first are validation:
    floor(n_c * val_size) of each label, and one more of the labels with the largest remainders (ties: the smaller
    label) until there are ceil(n * val_size) in all.  When a class has fewer than two rows
    (D9) the rank runs over all rows instead.  See ``hash_rank`` for the plan.  Keys and labels are written once,
    as ranks, bucket and label counts all read them: ``df`` itself, with its texts, is read for the result only.
    """
    checkpoint_dir(df.sparkSession)
    narrow = df.select(key, label).checkpoint()
    if stratify is None:
        m = narrow.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m")).first()["m"]
        stratify = (m or 0) >= 2
    r = hash_rank(df, key, [label] if stratify else [], seed, narrow)
    if not stratify:
        n_val = F.ceil(F.col("__n") * F.lit(float(val_size)))
        return r.withColumn("split", F.when(F.col("__rank") <= n_val, F.lit("val")).otherwise(F.lit("train"))).drop("__rank", "__n")
    # one row per label
    per = narrow.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__c"))
    share = F.col("__c") * F.lit(float(val_size))
    every = Window.partitionBy()
    order = Window.orderBy(F.desc(F.round(share - F.floor(share), 9)), F.asc_nulls_first("__label"))
    left = F.ceil(F.round(F.sum("__c").over(every) * F.lit(float(val_size)), 9)) - F.sum(F.floor(share)).over(every)
    quota = per.select("__label", (F.floor(share) + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).alias("__quota"))
    # a row a class: the texts are not shuffled by label
    j = r.join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("__label")))
    return j.withColumn("split", F.when(F.col("__rank") <= F.col("__quota"), F.lit("val")).otherwise(F.lit("train"))) \
        .drop("__rank", "__n", "__label", "__quota")


def balanced_mix(df: DataFrame, key: str, label: str = "label", target: int = 100_000, seed: int = 42) -> DataFrame:
    """Per label keep min(target, available) rows, chosen by hash rank (no sampling
    variance, no per-label window); ``shortfall`` tells how many a label lacked."""
    r = hash_rank(df, key, [label], seed)
    return r.where(F.col("__rank") <= target).withColumn("shortfall", F.greatest(F.lit(target) - F.col("__n"), F.lit(0))) \
        .drop("__rank", "__n")
