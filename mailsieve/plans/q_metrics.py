"""Plans for metrics, split, probabilities and decisions.

Evaluation set: labelled documents of the derived e-mail view; multi-class
prediction = the rule classifier's label; binary score = ``p_pos``; three
logits per row are doc_id arithmetic (so the oracle needs no trainer).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions.constants import CLASSES
from mailsieve.operators import metrics as M
from mailsieve.operators.classify import with_rules
from mailsieve.operators.corpus import canonical_label
from mailsieve.operators.score import decide
from mailsieve.plans.q_features import QUOTA_SQL
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import EMAIL_VIEW, rules_cte, sql_canonical
from mailsieve.sources.tables import labelled_email_view

# FIXED VALUES: per-class thresholds of the decision examples
THRESHOLDS = {"phishing": 0.72, "safe": 0.55, "spam": 0.91}
TEMPS = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)


def logits_col(i):
    return F.array(((i * 7) % 23) / F.lit(5.0) - 2.0, ((i * 11) % 29) / F.lit(5.0) - 2.0,
                   ((i * 13) % 31) / F.lit(5.0) - 2.0)


def eval_view(spark, sf):
    v = with_rules(labelled_email_view(spark, sf))
    lab = canonical_label("raw_label")
    e = v.select("doc_id", lab.alias("label"), F.col("rule.label").alias("pred"), "p_pos",
                 logits_col(F.col("doc_id")).alias("logits"))
    e = e.where(F.col("label").isin(*CLASSES))
    idx = F.when(F.col("label") == "phishing", 0).when(F.col("label") == "safe", 1).otherwise(2)
    return e.withColumn("y", (F.col("label") != "safe").cast("int")).withColumn("label_idx", idx)


_LOGIT_SQL = ("[CAST((doc_id * 7) % 23 AS DOUBLE) / 5.0 - 2.0, CAST((doc_id * 11) % 29 AS DOUBLE) / 5.0 - 2.0, "
              "CAST((doc_id * 13) % 31 AS DOUBLE) / 5.0 - 2.0]")
EVAL_SQL = f"""WITH {EMAIL_VIEW}, {rules_cte()}, ev0 AS (
  SELECT e.doc_id, {sql_canonical('e.raw_label')} AS label, r.label AS pred, e.p_pos,
    [CAST((e.doc_id * 7) % 23 AS DOUBLE) / 5.0 - 2.0, CAST((e.doc_id * 11) % 29 AS DOUBLE) / 5.0 - 2.0,
     CAST((e.doc_id * 13) % 31 AS DOUBLE) / 5.0 - 2.0] AS logits
  FROM email e JOIN rule r ON e.doc_id = r.doc_id
), ev AS (
  SELECT *, CASE WHEN label <> 'safe' THEN 1 ELSE 0 END AS y,
    CASE label WHEN 'phishing' THEN 0 WHEN 'safe' THEN 1 ELSE 2 END AS label_idx
  FROM ev0 WHERE label IN ('phishing', 'safe', 'spam')
)"""

CUM_SQL = """, sc AS (SELECT p_pos AS score, sum(y) AS pos, sum(1 - y) AS neg FROM ev GROUP BY p_pos),
cum AS (SELECT score, pos, neg,
  sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc),
pr AS (SELECT score AS threshold, tp / (tp + fp) AS precision, CASE WHEN P = 0 THEN 1.0 ELSE tp / P END AS recall, tp, fp, P, N, pos, neg FROM cum)"""


def r6(c):
    return F.round(c, 6)


@register("d10_confusion_matrix", EVAL_SQL + """, cls AS (SELECT * FROM (VALUES ('phishing'), ('safe'), ('spam')) t(label))
SELECT cls.label, CAST(count_if(ev.pred = 'phishing') AS BIGINT) AS phishing, CAST(count_if(ev.pred = 'safe') AS BIGINT) AS safe,
  CAST(count_if(ev.pred = 'spam') AS BIGINT) AS spam FROM cls LEFT JOIN ev ON ev.label = cls.label GROUP BY cls.label""")
def d10_confusion_matrix(spark, sf):
    return M.confusion_matrix(eval_view(spark, sf), "label", "pred", CLASSES)


_REPORT_SQL = EVAL_SQL + """, cls AS (SELECT * FROM (VALUES ('phishing'), ('safe'), ('spam')) t(class)),
st AS (SELECT class, (SELECT count_if(label = class AND pred = class) FROM ev) AS tp,
  (SELECT CAST(count_if(label = class) AS BIGINT) FROM ev) AS support, (SELECT count_if(pred = class) FROM ev) AS predicted FROM cls),
per AS (SELECT class, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support FROM st),
per2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * (precision * recall) / greatest(1.0 * precision + recall, 1e-12) END AS f1 FROM per),
tot AS (SELECT count(*) AS n, count_if(label = pred) AS n_correct FROM ev),
al AS (
  SELECT class, precision, recall, f1, support FROM per2
  UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0.0 ELSE n_correct / n END, n FROM tot
  UNION ALL SELECT 'macro avg', sum(precision) / 3, sum(recall) / 3, sum(f1) / 3, (SELECT n FROM tot) FROM per2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), (SELECT n FROM tot) FROM per2)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM al"""


@register("d11_classification_report", _REPORT_SQL)
def d11_classification_report(spark, sf):
    r = M.classification_report(eval_view(spark, sf), "label", "pred", CLASSES)
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@register("d12_accuracy", EVAL_SQL + " SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ev")
def d12_accuracy(spark, sf):
    return M.accuracy(eval_view(spark, sf), "label", "pred").select(r6("accuracy").alias("accuracy"))


@register("d13_macro_recall", EVAL_SQL + """ SELECT round((
  CASE WHEN count_if(label = 'phishing') = 0 THEN 0.0 ELSE count_if(label = 'phishing' AND pred = 'phishing') / count_if(label = 'phishing') END +
  CASE WHEN count_if(label = 'safe') = 0 THEN 0.0 ELSE count_if(label = 'safe' AND pred = 'safe') / count_if(label = 'safe') END +
  CASE WHEN count_if(label = 'spam') = 0 THEN 0.0 ELSE count_if(label = 'spam' AND pred = 'spam') / count_if(label = 'spam') END) / 3, 6)
  AS macro_recall FROM ev""")
def d13_macro_recall(spark, sf):
    return M.macro_recall(eval_view(spark, sf), "label", "pred", CLASSES).select(r6("macro_recall").alias("macro_recall"))


def _fb(p, r, b):
    b2 = b * b
    return f"CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE {1 + b2} * ({p} * {r}) / greatest({b2} * {p} + {r}, 1e-12) END"


@register("d14_fbeta_curve", EVAL_SQL + CUM_SQL + f""" SELECT threshold, round({_fb('precision', 'recall', 0.5)}, 6) AS f05,
  round({_fb('precision', 'recall', 1.0)}, 6) AS f1, round({_fb('precision', 'recall', 2.0)}, 6) AS f2 FROM pr""")
def d14_fbeta_curve(spark, sf):
    pr = M.pr_curve(eval_view(spark, sf), "p_pos", "y")
    return pr.select("threshold", *[r6(M.fbeta("precision", "recall", b)).alias(n) for n, b in
                                    (("f05", 0.5), ("f1", 1.0), ("f2", 2.0))])


@register("d15_pr_curve", EVAL_SQL + CUM_SQL + """ SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM pr""")
def d15_pr_curve(spark, sf):
    pr = M.pr_curve(eval_view(spark, sf), "p_pos", "y")
    return pr.select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"),
                     F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"))


@register("e04_cumulative_counts", EVAL_SQL + CUM_SQL + """ SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(P AS BIGINT) AS P, CAST(N AS BIGINT) AS N FROM cum""")
def e04_cumulative_counts(spark, sf):
    c = M.cumulative_counts(eval_view(spark, sf), "p_pos", "y")
    return c.select("score", *[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "P", "N")])


@register("d16_average_precision", EVAL_SQL + CUM_SQL + """ SELECT round(sum(CASE WHEN P = 0 THEN 0.0 ELSE (pos / P) * precision END), 6)
  AS average_precision FROM pr""")
def d16_average_precision(spark, sf):
    return M.average_precision(eval_view(spark, sf), "p_pos", "y").select(r6("average_precision").alias("average_precision"))


@register("d17_roc_points", EVAL_SQL + CUM_SQL + """ SELECT threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM pr""")
def d17_roc_points(spark, sf):
    r = M.roc_points(eval_view(spark, sf), "p_pos", "y")
    return r.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("d18_roc_auc", EVAL_SQL + CUM_SQL + """ SELECT round(sum(neg * (tp + (tp - pos)) / 2.0) / (max(P) * max(N)), 6) AS roc_auc FROM pr""")
def d18_roc_auc(spark, sf):
    return M.roc_auc(eval_view(spark, sf), "p_pos", "y").select(r6("roc_auc").alias("roc_auc"))


_CW_SQL = EVAL_SQL + """, tr AS (SELECT label, count(*) AS n_c FROM ev GROUP BY label)"""


@register("d07_class_weights", _CW_SQL + """ SELECT label, n_c, round(CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c), 6) AS weight FROM tr""")
def d07_class_weights(spark, sf):
    w = M.class_weights(eval_view(spark, sf), "label", "balanced")
    return w.select("label", "n_c", r6("weight").alias("weight"))


@register("d08_sample_weights", _CW_SQL + """ SELECT e.doc_id, e.label, round(1.0 / greatest(t.n_c, 1), 6) AS weight
  FROM ev e JOIN tr t ON e.label = t.label""")
def d08_sample_weights(spark, sf):
    ev = eval_view(spark, sf)
    w = M.class_weights(ev, "label", "inverse")
    return M.with_sample_weight(ev, w).select("doc_id", "label", r6("weight").alias("weight"))


@register("d09_min_class_count", _CW_SQL + " SELECT min(n_c) AS min_class_count, CAST(min(n_c) >= 2 AS INTEGER) AS stratified FROM tr")
def d09_min_class_count(spark, sf):
    w = M.class_weights(eval_view(spark, sf), "label", "inverse")
    return w.agg(F.min("n_c").alias("min_class_count"), (F.min("n_c") >= 2).cast("int").alias("stratified"))


_SOFTMAX_SQL = """, sm AS (SELECT doc_id, label_idx, logits,
  list_transform(logits, lambda z: exp(z - list_max(logits))) AS e FROM ev),
pr3 AS (SELECT doc_id, label_idx, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sm)"""


@register("h20_softmax", EVAL_SQL + _SOFTMAX_SQL + """ SELECT doc_id, round(p[1], 6) AS p_phishing, round(p[2], 6) AS p_safe,
  round(p[3], 6) AS p_spam FROM pr3""")
def h20_softmax(spark, sf):
    p = M.softmax(F.col("logits"))
    e = eval_view(spark, sf).select("doc_id", p.alias("p"))
    return e.select("doc_id", *[r6(F.col("p")[i]).alias(f"p_{c}") for i, c in enumerate(CLASSES)])


@register("h21_temperature_scaling", EVAL_SQL + """, sm AS (SELECT doc_id, list_transform(logits, lambda z: z / greatest(2.0, 1e-6)) AS z FROM ev),
sm2 AS (SELECT doc_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM sm),
pr3 AS (SELECT doc_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sm2)
SELECT doc_id, round(p[1], 6) AS p_phishing, round(p[2], 6) AS p_safe, round(p[3], 6) AS p_spam FROM pr3""")
def h21_temperature_scaling(spark, sf):
    p = M.softmax(M.temperature_scale(F.col("logits"), 2.0))
    e = eval_view(spark, sf).select("doc_id", p.alias("p"))
    return e.select("doc_id", *[r6(F.col("p")[i]).alias(f"p_{c}") for i, c in enumerate(CLASSES)])


@register("d19_cross_entropy", EVAL_SQL + _SOFTMAX_SQL + """, w AS (SELECT label_idx, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS wt FROM ev GROUP BY label_idx)
SELECT round(avg(-ln(p[pr3.label_idx + 1])), 6) AS cross_entropy,
  round(sum(w.wt * -ln(p[pr3.label_idx + 1])) / sum(w.wt), 6) AS weighted_cross_entropy
FROM pr3 JOIN w ON pr3.label_idx = w.label_idx""")
def d19_cross_entropy(spark, sf):
    ev = eval_view(spark, sf)
    w = M.class_weights(ev, "label", "balanced")
    x = M.with_sample_weight(ev, w).withColumn("probs", M.softmax(F.col("logits")))
    plain = M.cross_entropy(x, "probs", "label_idx").select(r6("cross_entropy").alias("cross_entropy"))
    weighted = M.cross_entropy(x, "probs", "label_idx", "weight").select(r6("cross_entropy").alias("weighted")).scalar()
    return plain.select("cross_entropy", weighted.alias("weighted_cross_entropy"))


_TGRID_SQL = EVAL_SQL + """, t AS (SELECT unnest([""" + ", ".join(f"CAST({t} AS DOUBLE)" for t in TEMPS) + """]) AS T),
x AS (SELECT ev.doc_id, ev.label_idx, t.T, list_transform(ev.logits, lambda z: z / greatest(t.T, 1e-6)) AS z FROM ev, t),
x2 AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM x),
x3 AS (SELECT T, -ln(e[label_idx + 1] / list_sum(e)) AS nll FROM x2),
g AS (SELECT T, avg(nll) AS nll FROM x3 GROUP BY T)"""


@register("m13_temperature_grid", _TGRID_SQL + " SELECT T, round(nll, 6) AS nll FROM g")
def m13_temperature_grid(spark, sf):
    g = M.temperature_grid_nll(eval_view(spark, sf), "logits", "label_idx", TEMPS)
    return g.select("T", r6("nll").alias("nll"))


@register("m13_fitted_temperature", "WITH RECURSIVE " + EVAL_SQL[len("WITH "):] + """,
bis AS (SELECT 0 AS i, ln(1e-6) AS lo, ln(1e12) AS hi
  UNION ALL SELECT i + 1, CASE WHEN d > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN d > 0 THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, sum(list_sum(list_transform(list_zip(logits, e), lambda x: x[1] * x[2])) / list_sum(e) - logits[label_idx + 1]) AS d FROM (
      SELECT i, lo, hi, logits, label_idx, list_transform(logits, lambda z: exp((z - list_max(logits)) * exp(-(lo + hi) / 2))) AS e FROM bis, ev)
    GROUP BY i, lo, hi) WHERE i < 70)
SELECT round(exp((lo + hi) / 2), 6) AS temperature FROM bis WHERE i = 70""")
def m13_fitted_temperature(spark, sf):
    """The fitted temperature (Newton steps; the SQL bisects the same slope)."""
    ev = eval_view(spark, sf).select("logits", "label_idx").checkpoint()
    return spark.createDataFrame([(round(M.fit_temperature(ev, "logits", "label_idx"), 6),)], "temperature double")


@register("e03_best_candidate", _TGRID_SQL + " SELECT T, round(nll, 6) AS nll FROM g ORDER BY -nll DESC, T ASC LIMIT 1")
def e03_best_candidate(spark, sf):
    g = M.temperature_grid_nll(eval_view(spark, sf), "logits", "label_idx", TEMPS).withColumn("neg_nll", -F.col("nll"))
    return M.best_candidate(g, "neg_nll", "T").select("T", r6("nll").alias("nll"))


def _tune_sql():
    base = EVAL_SQL + CUM_SQL + """, cand AS (SELECT threshold, precision, recall, 0 AS final FROM pr
  UNION ALL SELECT 1.0, 1.0, 0.0, 1)"""
    parts = []
    for name, expr, where in (("f1", _fb("precision", "recall", 1.0), "TRUE"),
                              ("f2", _fb("precision", "recall", 2.0), "TRUE"),
                              ("f0.5", _fb("precision", "recall", 0.5), "TRUE"),
                              ("recall", "recall", "precision >= 0.9"),
                              ("precision", "precision", "TRUE")):
        parts.append(f"(SELECT '{name}' AS metric, threshold, round({expr}, 6) AS metric_score FROM cand WHERE {where} "
                     f"ORDER BY {expr} DESC, final ASC, threshold ASC LIMIT 1)")
    return base + " " + " UNION ALL ".join(parts)


@register("m14_tune_threshold", _tune_sql())
def m14_tune_threshold(spark, sf):
    # the curve (a row per distinct score) is written once for all metrics
    curve = M.pr_curve(eval_view(spark, sf), "p_pos", "y").checkpoint()
    out = None
    for metric, target in (("f1", None), ("f2", None), ("f0.5", None), ("recall", 0.9), ("precision", None)):
        t = M.tune_on_curve(curve, metric, target).select("metric", "threshold", r6("metric_score").alias("metric_score"))
        out = t if out is None else out.unionByName(t)
    return out


@register("m15_selection_score", EVAL_SQL + CUM_SQL + """, cand AS (SELECT threshold, precision, recall, 0 AS final FROM pr UNION ALL SELECT 1.0, 1.0, 0.0, 1),
best AS (SELECT threshold FROM cand ORDER BY """ + _fb("precision", "recall", 2.0) + """ DESC, final ASC, threshold ASC LIMIT 1),
c AS (SELECT count_if(ev.p_pos >= best.threshold AND y = 1) AS tp, count_if(ev.p_pos >= best.threshold) AS pp, count_if(y = 1) AS ap FROM ev, best),
pr2 AS (SELECT CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS p, CASE WHEN ap = 0 THEN 0.0 ELSE tp / ap END AS r FROM c)
SELECT round(""" + _fb("p", "r", 2.0) + """, 6) AS f2_at_tuned FROM pr2""")
def m15_selection_score(spark, sf):
    ev = eval_view(spark, sf)
    thr = M.tune_threshold(ev, "p_pos", "y", "f2").select("threshold").scalar()
    return M.binary_fbeta_at(ev, "p_pos", "y", thr, 2.0).select(r6("fbeta").alias("f2_at_tuned"))


_DECIDE_SQL = EVAL_SQL + _SOFTMAX_SQL + """, d AS (
  SELECT doc_id, p, list_position(p, list_max(p)) AS top_i,
    list_filter([{'label': 'phishing', 'prob': p[1], 'ok': p[1] >= 0.72},
                 {'label': 'safe', 'prob': p[2], 'ok': p[2] >= 0.55},
                 {'label': 'spam', 'prob': p[3], 'ok': p[3] >= 0.91}], lambda s: s.ok) AS passed
  FROM pr3
), d2 AS (
  SELECT doc_id, p, top_i, list_sort(list_transform(passed, lambda s: {'neg': -s.prob, 'label': s.label, 'prob': s.prob})) AS ps FROM d
)
SELECT doc_id,
  ['phishing', 'safe', 'spam'][top_i] AS raw_label, round(p[top_i], 6) AS raw_prob,
  CASE WHEN len(ps) > 0 THEN ps[1].label ELSE ['phishing', 'safe', 'spam'][top_i] END AS label,
  round(CASE WHEN len(ps) > 0 THEN ps[1].prob ELSE p[top_i] END, 6) AS prob,
  CASE WHEN len(ps) > 0 THEN 'passed_threshold' ELSE 'no_class_met_threshold' END AS fallback_reason
FROM d2"""


@register("m11_threshold_decision", _DECIDE_SQL)
def m11_threshold_decision(spark, sf):
    ev = eval_view(spark, sf).withColumn("probs", M.softmax(F.col("logits")))
    d = decide(F.col("probs"), CLASSES, THRESHOLDS)
    return ev.select("doc_id", d.alias("d")).select(
        "doc_id", F.col("d.raw_top.label").alias("raw_label"), r6(F.col("d.raw_top.prob")).alias("raw_prob"),
        F.col("d.winner.label").alias("label"), r6(F.col("d.winner.prob")).alias("prob"),
        F.col("d.fallback_reason").alias("fallback_reason"))


@register("f06_argmax_class", EVAL_SQL + _SOFTMAX_SQL + """ SELECT doc_id, ['phishing', 'safe', 'spam'][list_position(p, list_max(p))] AS label,
  round(list_max(p), 6) AS prob FROM pr3""")
def f06_argmax_class(spark, sf):
    ev = eval_view(spark, sf).withColumn("probs", M.softmax(F.col("logits")))
    d = decide(F.col("probs"), CLASSES, {})
    return ev.select("doc_id", F.col("probs"), d.alias("d")).select(
        "doc_id", F.col("d.winner.label").alias("label"), r6(F.col("d.winner.prob")).alias("prob"))


@register("h25_prob_map", EVAL_SQL + _SOFTMAX_SQL + """ SELECT doc_id, k AS class, round(v, 6) AS prob FROM
  (SELECT doc_id, unnest(['phishing', 'safe', 'spam']) AS k, unnest(p) AS v FROM pr3)""")
def h25_prob_map(spark, sf):
    from mailsieve.operators.score import prob_map

    ev = eval_view(spark, sf).withColumn("probs", M.softmax(F.col("logits")))
    m = ev.select("doc_id", prob_map(F.col("probs"), CLASSES).alias("m"))
    return m.select("doc_id", F.explode("m").alias("class", "prob")).withColumn("prob", r6("prob"))


@register("m06_stratified_split", f"""WITH {EMAIL_VIEW}, ev AS (
  SELECT doc_id, {sql_canonical('raw_label')} AS label FROM email), t AS (SELECT * FROM ev WHERE label IN ('phishing', 'safe', 'spam')),
{QUOTA_SQL % 't'},
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM t)
SELECT doc_id, r.label, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END AS split FROM r JOIN q ON r.label = q.label""")
def m06_stratified_split(spark, sf):
    ev = eval_view(spark, sf).select("doc_id", "label")
    return M.stratified_split(ev, "doc_id", "label", 0.2, 42, stratify=True).select("doc_id", "label", "split")


@register("m18_eval_report", EVAL_SQL + CUM_SQL + """, tot AS (SELECT count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS acc FROM ev),
ap AS (SELECT sum(CASE WHEN P = 0 THEN 0.0 ELSE (pos / P) * precision END) AS ap,
  sum(neg * (tp + (tp - pos)) / 2.0) / (max(P) * max(N)) AS auc FROM pr)
SELECT n AS n_eval, round(acc, 6) AS accuracy, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc FROM tot, ap""")
def m18_eval_report(spark, sf):
    ev = eval_view(spark, sf)
    ap = M.average_precision(ev, "p_pos", "y").select("average_precision").scalar()
    auc = M.roc_auc(ev, "p_pos", "y").select("roc_auc").scalar()
    return ev.agg(F.count(F.lit(1)).alias("n_eval"), r6(F.avg((F.col("label") == F.col("pred")).cast("double"))).alias("accuracy"),
                  r6(ap).alias("average_precision"), r6(auc).alias("roc_auc"))


def _print_sql(table: str, columns: list[str]) -> str:
    one = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns)
    return (f"(SELECT CAST(count(*) AS VARCHAR) || ':' || CAST(coalesce(sum(CAST('0x' || md5(concat_ws(chr(31), {one}))[1:8] AS BIGINT)), 0) AS VARCHAR) "
            f"FROM {table})")


_RECORD_SQL = _REPORT_SQL[:_REPORT_SQL.rindex("SELECT class, round(precision")] + f""", long AS (
  SELECT 'report' AS section, class AS name, 'precision' AS field, precision AS value, '' AS text FROM al
  UNION ALL SELECT 'report', class, 'recall', recall, '' FROM al UNION ALL SELECT 'report', class, 'f1', f1, '' FROM al
  UNION ALL SELECT 'report', class, 'support', support, '' FROM al
  UNION ALL SELECT 'confusion', a.class, b.class, (SELECT count_if(label = a.class AND pred = b.class) FROM ev), '' FROM cls a, cls b
  UNION ALL SELECT 'class_counts', label, 'n', count(*), '' FROM ev GROUP BY label
  UNION ALL SELECT 'run', 'accuracy', '', (SELECT n_correct / n FROM tot), ''
  UNION ALL SELECT 'run', 'tuned_threshold', '', 0.5, ''
  UNION ALL SELECT 'inputs', 'documents', '', NULL, {_print_sql('documents', ['doc_id', 'text'])}
  UNION ALL SELECT 'inputs', 'labels', '', NULL, {_print_sql('labels', ['doc_id', 'quality', 'toxic'])}
  UNION ALL SELECT 'params', 'seed', '', NULL, '42')
SELECT section, name, field, round(CAST(value AS DOUBLE), 6) AS value, text FROM long"""


@register("m18_run_record", _RECORD_SQL)
def m18_run_record(spark, sf):
    """The one row of a run, laid out in lines."""
    from mailsieve.session import read_table

    ev = eval_view(spark, sf).select("label", "pred").checkpoint()
    inputs = {"documents": read_table(spark, sf, "documents").select("doc_id", "text"),
              "labels": read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")}
    one = M.run_record(ev, "label", "pred", CLASSES, inputs=inputs, params={"seed": 42}, tuned_threshold=0.5)

    def line(section, name, field, value=None, text=F.lit("")):
        value = F.lit(None) if value is None else value
        return F.struct(F.lit(section).alias("section"), name.alias("name"), field.alias("field"), value.cast("double").alias("value"), text.alias("text"))

    none = F.lit("")
    report = F.flatten(F.transform("report", lambda r: F.array(*[line("report", r["class"], F.lit(c), r[c]) for c in ("precision", "recall", "f1", "support")])))
    matrix = F.flatten(F.transform("confusion_matrix", lambda r: F.array(*[line("confusion", r["label"], F.lit(c), r["predicted"][i]) for i, c in enumerate(CLASSES)])))
    counts = F.transform(F.map_entries("class_counts"), lambda e: line("class_counts", e["key"], F.lit("n"), e["value"]))
    run = F.array(*[line("run", F.lit(c), none, F.col(c)) for c in ("accuracy", "tuned_threshold")])
    texts = [F.transform(F.map_entries("inputs"), lambda e: line("inputs", e["key"], none, None, e["value"])),
             F.transform(F.map_entries("params"), lambda e: line("params", e["key"], none, None, e["value"]))]
    lines = one.select(F.explode(F.concat(report, matrix, counts, run, *texts)).alias("l")).select("l.*")
    return lines.select("section", "name", "field", r6("value").alias("value"), "text")


_SAT_SQL = EVAL_SQL + """, sat AS (SELECT doc_id, y, CASE WHEN doc_id % 2 = 0 THEN pow(10.0, -(doc_id % 300)) / (1 + doc_id)
  ELSE 1 - pow(2.0, -(doc_id % 50)) / (1 + doc_id) END AS s FROM ev),
g AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM sat GROUP BY s),
cum AS (SELECT s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g
  WINDOW w AS (ORDER BY s DESC))
"""


@register("d15_saturated_scores", _SAT_SQL + "SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(P AS BIGINT) AS p_all, "
          "CAST(N AS BIGINT) AS n_all FROM cum")
def d15_saturated_scores(spark, sf):
    """The curve over scores that are all different and crowd at 0 and 1."""
    i = F.col("doc_id")
    s = F.when(i % 2 == 0, F.pow(F.lit(10.0), -(i % 300).cast("double")) / (1 + i)).otherwise(
        1 - F.pow(F.lit(2.0), -(i % 50).cast("double")) / (1 + i))
    c = M.cumulative_counts(eval_view(spark, sf).withColumn("s", s), "s", "y")
    return c.select(*[F.col(a).cast("long").alias(b) for a, b in (("tp", "tp"), ("fp", "fp"), ("P", "p_all"), ("N", "n_all"))])
