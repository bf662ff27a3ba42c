"""Plans for model fit and scoring.

Model: multinomial NB over word TF-IDF, fit on the training split; scored on
the validation split.  Its fit is exact aggregation, so every step has a SQL
restatement.  The Spark-ML logistic regression trainer is rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions.constants import CLASSES
from mailsieve.operators import score as SC
from mailsieve.operators.train import naive_bayes, train_job
from mailsieve.plans.q_features import FEAT_WORD_SQL, SMALL_CAPS, STOP_SQL, WORD_RE, split_rows
from mailsieve.plans.q_metrics import THRESHOLDS
from mailsieve.plans.q_scans import scans_sql
from mailsieve.plans.registry import register
from mailsieve.sources.tables import corpus_view


def _nb(spark, sf):
    from mailsieve.operators import features as FE

    s = split_rows(spark, sf).checkpoint()
    tr = s.where(F.col("split") == "train")
    va = s.where(F.col("split") == "val")
    vocab, f_tr, f_va = FE.fit_transform(tr, va, max_features={"word": SMALL_CAPS["word"]})
    weights, intercepts = naive_bayes(f_tr, tr, vocab, CLASSES, tasks=FE.size_of(tr)[1])
    weights = weights.checkpoint()  # bounded by the vocabulary; scoring and explaining do not fit again
    return va, f_va, weights, intercepts


NB_SQL = FEAT_WORD_SQL + """,
cls AS (SELECT unnest(['phishing', 'safe', 'spam']) AS label),
ft AS (SELECT f.ns, f.term, f.value, s.label FROM feat f JOIN split s ON f.doc_id = s.doc_id WHERE f.split = 'train'),
sums AS (SELECT ns, term, label, sum(value) AS s FROM ft GROUP BY ns, term, label),
tot AS (SELECT label, sum(value) AS t FROM ft GROUP BY label),
vs AS (SELECT count(*) AS V FROM vocab),
lp AS (SELECT v.ns, v.term, c.label, ln((coalesce(s.s, 0.0) + 1.0) / (coalesce(t.t, 0.0) + 1.0 * vs.V)) AS lp
  FROM vocab v CROSS JOIN cls c CROSS JOIN vs
  LEFT JOIN sums s ON s.ns = v.ns AND s.term = v.term AND s.label = c.label LEFT JOIN tot t ON t.label = c.label),
wt AS (SELECT ns, term, label, lp - avg(lp) OVER (PARTITION BY ns, term) AS weight FROM lp),
ntr AS (SELECT count(*) AS n FROM split WHERE split = 'train'),
prior AS (SELECT s.label, ln(count(*) / max(ntr.n)) AS intercept FROM split s, ntr WHERE s.split = 'train' GROUP BY s.label),
dots AS (SELECT f.doc_id, w.label, sum(f.value * w.weight) AS dot FROM feat f JOIN wt w ON f.ns = w.ns AND f.term = w.term
  WHERE f.split = 'val' GROUP BY f.doc_id, w.label),
vd AS (SELECT doc_id FROM split WHERE split = 'val'),
lg AS (SELECT vd.doc_id, [
    coalesce((SELECT dot FROM dots d WHERE d.doc_id = vd.doc_id AND d.label = 'phishing'), 0.0) + (SELECT intercept FROM prior WHERE label = 'phishing'),
    coalesce((SELECT dot FROM dots d WHERE d.doc_id = vd.doc_id AND d.label = 'safe'), 0.0) + (SELECT intercept FROM prior WHERE label = 'safe'),
    coalesce((SELECT dot FROM dots d WHERE d.doc_id = vd.doc_id AND d.label = 'spam'), 0.0) + (SELECT intercept FROM prior WHERE label = 'spam')] AS z
  FROM vd),
sm AS (SELECT doc_id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM lg),
pr3 AS (SELECT doc_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sm)"""

DECIDE_SQL = """, d AS (
  SELECT doc_id, p, list_position(p, list_max(p)) AS top_i,
    list_filter([{'label': 'phishing', 'prob': p[1], 'ok': p[1] >= 0.72},
                 {'label': 'safe', 'prob': p[2], 'ok': p[2] >= 0.55},
                 {'label': 'spam', 'prob': p[3], 'ok': p[3] >= 0.91}], lambda s: s.ok) AS passed
  FROM pr3
), d2 AS (
  SELECT doc_id, p, top_i, list_sort(list_transform(passed, lambda s: {'neg': -s.prob, 'label': s.label, 'prob': s.prob})) AS ps FROM d
), dec AS (
  SELECT doc_id, ['phishing', 'safe', 'spam'][top_i] AS raw_label, p[top_i] AS raw_prob,
    CASE WHEN len(ps) > 0 THEN ps[1].label ELSE ['phishing', 'safe', 'spam'][top_i] END AS label,
    CASE WHEN len(ps) > 0 THEN ps[1].prob ELSE p[top_i] END AS prob,
    CASE WHEN len(ps) > 0 THEN 'passed_threshold' ELSE 'no_class_met_threshold' END AS fallback_reason
  FROM d2)"""


@register("m09_naive_bayes_weights", NB_SQL + """ SELECT label, count(*) AS n_terms, round(sum(weight), 6) AS sum_weight,
  round(max(weight), 6) AS max_weight FROM wt GROUP BY label""")
def m09_naive_bayes_weights(spark, sf):
    _, _, w, _ = _nb(spark, sf)
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("sum_weight"),
                                  F.round(F.max("weight"), 6).alias("max_weight"))


@register("c06_feature_weight_product", NB_SQL + " SELECT doc_id, label, round(dot, 6) AS dot FROM dots")
def c06_feature_weight_product(spark, sf):
    _, f_va, w, _ = _nb(spark, sf)
    return SC.class_scores(f_va, w).select("doc_id", "label", F.round("dot", 6).alias("dot"))


@register("m10_score_linear", NB_SQL + DECIDE_SQL + """ SELECT doc_id, raw_label, round(raw_prob, 6) AS raw_prob, label,
  round(prob, 6) AS confidence, fallback_reason FROM dec""")
def m10_score_linear(spark, sf):
    va, f_va, w, ic = _nb(spark, sf)
    p = SC.predict(va.select("doc_id"), f_va, w, ic, CLASSES, thresholds=THRESHOLDS)
    return p.select("doc_id", F.col("decision.raw_top.label").alias("raw_label"),
                    F.round("decision.raw_top.prob", 6).alias("raw_prob"), "label",
                    F.round("confidence", 6).alias("confidence"), F.col("decision.fallback_reason").alias("fallback_reason"))


@register("c08_attach_thresholds", NB_SQL + """ SELECT doc_id, c.label, round(p[c.i], 6) AS prob, c.tau,
  CAST(p[c.i] >= c.tau AS INTEGER) AS passed FROM pr3,
  (SELECT * FROM (VALUES ('phishing', 1, 0.72), ('safe', 2, 0.55), ('spam', 3, 0.91)) t(label, i, tau)) c""")
def c08_attach_thresholds(spark, sf):
    va, f_va, w, ic = _nb(spark, sf)
    p = SC.predict(va.select("doc_id"), f_va, w, ic, CLASSES, thresholds=THRESHOLDS)
    x = p.select("doc_id", F.explode("decision.thresholds_used").alias("label", "tau"), "prob_map")
    return x.select("doc_id", "label", F.round(F.col("prob_map")[F.col("label")], 6).alias("prob"),
                    F.col("tau").cast("decimal(3,2)").alias("tau"),
                    (F.col("prob_map")[F.col("label")] >= F.col("tau")).cast("int").alias("passed"))


@register("m16_top_reasons", NB_SQL + """, top AS (
  SELECT doc_id, ['phishing', 'safe', 'spam'][list_position(p, list_max(p))] AS label FROM pr3),
con AS (SELECT f.doc_id, f.ns, f.term, f.value * w.weight AS c FROM feat f JOIN top t ON f.doc_id = t.doc_id
  JOIN wt w ON w.ns = f.ns AND w.term = f.term AND w.label = t.label WHERE f.split = 'val' AND f.value * w.weight > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 9) DESC, ns ASC, term ASC) AS rn FROM con)
SELECT vd.doc_id, coalesce(string_agg(term, ', ' ORDER BY rn), '') AS reasons, count(rn) AS n_reasons
FROM vd LEFT JOIN (SELECT * FROM rk WHERE rn <= 6) r ON r.doc_id = vd.doc_id GROUP BY vd.doc_id""")
def m16_top_reasons(spark, sf):
    va, f_va, w, ic = _nb(spark, sf)
    r = SC.predict_explained(va.select("doc_id"), f_va, w, ic, CLASSES)
    return r.select("doc_id", F.array_join(F.transform("reasons", lambda s: s["token"]), ", ").alias("reasons"),
                    F.size("reasons").cast("long").alias("n_reasons"))


@register("m09_train_logreg")
def m09_train_logreg(spark, sf):
    """Spark-ML class-weighted multinomial LR, best regParam on the validation split (rows-only)."""
    res = train_job(corpus_view(spark, sf), max_features={"word": SMALL_CAPS["word"]})
    return res["report"]


SOFTMAX = {"epochs": 3, "batches": 3, "lr": 0.05, "weight_decay": 1e-4}


def _softmax_sql() -> str:
    """The trainer's steps restated: one set of CTEs a batch, then the recall of every epoch on the validation rows."""
    n, lr, decay = SOFTMAX["batches"], SOFTMAX["lr"], SOFTMAX["weight_decay"]
    sql = FEAT_WORD_SQL + f""",
cls AS (SELECT unnest(['phishing', 'safe', 'spam']) AS label),
cw AS (SELECT label, count(*) AS c FROM split WHERE split = 'train' GROUP BY label),
cwt AS (SELECT label, (SELECT sum(c) FROM cw) / ((SELECT count(*) FROM cw) * CAST(c AS DOUBLE)) AS weight FROM cw),
docs AS MATERIALIZED (SELECT doc_id, s.split AS split, s.label AS y, weight, CAST('0x' || md5('42:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) % {n} AS b
  FROM split s LEFT JOIN cwt ON cwt.label = s.label),
rows0 AS MATERIALIZED (SELECT doc_id, ns, term, value FROM feat UNION ALL SELECT doc_id, 'bias', '', 1.0 FROM docs),
tot AS (SELECT b, sum(weight) AS total FROM docs WHERE split = 'train' GROUP BY b),
s0 AS (SELECT ns, term, label, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v
  FROM (SELECT ns, term FROM vocab UNION ALL SELECT 'bias', '') CROSS JOIN cls)"""

    def logits(state: str, where: str) -> str:
        return (f"SELECT r.doc_id AS doc_id, s.label AS label, sum(value * w) AS z FROM rows0 r JOIN docs USING (doc_id) "
                f"JOIN {state} s ON s.ns = r.ns AND s.term = r.term WHERE {where} GROUP BY 1, 2")

    t = 0
    for epoch in range(1, SOFTMAX["epochs"] + 1):
        for b in range(n):
            t += 1
            sql += f""",
z{t} AS MATERIALIZED ({logits(f's{t - 1}', f"split = 'train' AND b = {b}")}),
e{t} AS (SELECT doc_id, label, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM z{t}),
d{t} AS MATERIALIZED (SELECT doc_id, label, weight * (e / sum(e) OVER (PARTITION BY doc_id) - CASE WHEN y = label THEN 1.0 ELSE 0.0 END) / total AS d
  FROM e{t} JOIN docs USING (doc_id) JOIN tot USING (b)),
g{t} AS (SELECT ns, term, label, sum(value * d) AS g FROM rows0 JOIN d{t} USING (doc_id) GROUP BY 1, 2, 3),
n{t} AS (SELECT ns, term, label, w, m * 0.9::DOUBLE + coalesce(g, 0) * 0.1::DOUBLE AS m, v * 0.999::DOUBLE + coalesce(g, 0) * coalesce(g, 0) * 0.001::DOUBLE AS v
  FROM s{t - 1} LEFT JOIN g{t} USING (ns, term, label)),
s{t} AS MATERIALIZED (SELECT ns, term, label, w * (1 - {lr * decay}::DOUBLE) -
  {lr}::DOUBLE * (m / (1 - pow(0.9::DOUBLE, {t}))) / (sqrt(v / (1 - pow(0.999::DOUBLE, {t}))) + 1e-8::DOUBLE) AS w, m, v FROM n{t})"""
        sql += f""",
v{epoch} AS ({logits(f's{t}', "split = 'val'")}),
p{epoch} AS (SELECT doc_id, arg_min(label, (-z, label)) AS pred FROM (SELECT doc_id, label, round(z, 12) AS z FROM v{epoch}) GROUP BY doc_id),
r{epoch} AS (SELECT {epoch} AS epoch, avg(recall) AS macro_recall FROM (SELECT c.label, coalesce(avg(CAST(pred = y AS DOUBLE)), 0.0) AS recall
  FROM cls c LEFT JOIN (SELECT * FROM docs JOIN p{epoch} USING (doc_id)) x ON x.y = c.label GROUP BY c.label))"""
    return sql


def _softmax(spark, sf):
    """M9: AdamW steps over the training split's TF-IDF rows, three epochs of three batches."""
    from mailsieve.operators import features as FE
    from mailsieve.operators import softmax

    s = split_rows(spark, sf).checkpoint()
    tr, va = (s.where(F.col("split") == x) for x in ("train", "val"))
    vocab, f_tr, f_va = FE.fit_transform(tr, va, max_features={"word": SMALL_CAPS["word"]})
    return softmax.train(f_tr, tr, vocab, f_va, va, classes=CLASSES, **SOFTMAX)


_SOFTMAX_STEPS = SOFTMAX["epochs"] * SOFTMAX["batches"]


@register("m09_train_softmax", _softmax_sql() + f" SELECT ns, term, label, round(w, 6) AS weight FROM s{_SOFTMAX_STEPS}")
def m09_train_softmax(spark, sf):
    """Every weight after the last epoch."""
    last = _softmax(spark, sf)["last"]
    names = F.array(*[F.lit(c) for c in CLASSES])
    return last.select("ns", "term", F.posexplode("w").alias("i", "weight")).select(
        "ns", "term", names[F.col("i")].alias("label"), F.round("weight", 6).alias("weight"))


@register("m09_softmax_epochs", _softmax_sql() + ", r AS (" + " UNION ALL ".join(f"SELECT * FROM r{e}" for e in range(1, SOFTMAX["epochs"] + 1)) + """)
SELECT epoch, round(macro_recall, 6) AS macro_recall, epoch = (SELECT min(epoch) FROM r WHERE macro_recall = (SELECT max(macro_recall) FROM r)) AS chosen FROM r""")
def m09_softmax_epochs(spark, sf):
    """The selection score of every epoch, and the epoch whose state is the model."""
    model = _softmax(spark, sf)
    rows = [(e, round(float(score), 6), e == model["best_epoch"]) for e, score in model["history"]]
    return spark.createDataFrame(rows, "epoch int, macro_recall double, chosen boolean")


@register("a17_thresholds_json", """SELECT doc_id, CAST(round(0.5 + (doc_id % 40) / 100.0, 2) AS DECIMAL(3,2)) AS phishing_tau FROM documents""")
def a17_thresholds_json(spark, sf):
    """Threshold JSON documents derived per row; 'chosen' wins, else the max numeric."""
    from mailsieve.session import read_table

    d = read_table(spark, sf, "documents").select("doc_id")
    v = (F.lit(0.5) + (F.col("doc_id") % 40) / F.lit(100.0))
    js = F.when(F.col("doc_id") % 2 == 0,
                F.format_string('{"threshold_suggestions": {"phishing": {"prec_at_95": %s, "chosen": %s}, "spam": 3}}', v, v)) \
        .otherwise(F.format_string('{"threshold_suggestions": {"phishing": {"a": 0.1, "b": %s}}}', v))
    t = SC.thresholds_from_json(d.withColumn("json", js))
    return t.select("doc_id", F.round(F.col("thresholds")["phishing"], 2).cast("decimal(3,2)").alias("phishing_tau"))


# the model's tables from NB_SQL, the e-mails and survivors from the scan; the survivors' texts are scored
_SCAN_NB_SQL = NB_SQL + ", " + scans_sql()[len("WITH "):] + f""", etok AS (SELECT email_id,
  list_filter(regexp_extract_all(lower(body_text), '{WORD_RE}'), lambda t: NOT list_contains({STOP_SQL}, t)) AS toks FROM surv),
eg AS (SELECT email_id, unnest(toks) AS term FROM etok
  UNION ALL SELECT email_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM etok),
etf AS (SELECT email_id, term, count(*) AS tf FROM eg GROUP BY email_id, term),
ew AS (SELECT t.email_id, v.ns, t.term, (1.0 + ln(t.tf)) * v.idf AS w FROM etf t JOIN vocab v ON v.ns = 'word' AND v.term = t.term),
ef AS (SELECT email_id, ns, term, w / sqrt(sum(w * w) OVER (PARTITION BY email_id)) AS value FROM ew),
ed AS (SELECT e.email_id, w.label, sum(e.value * w.weight) AS dot FROM ef e JOIN wt w ON e.ns = w.ns AND e.term = w.term GROUP BY 1, 2),
ez AS (SELECT s.email_id, [""" + ", ".join(
    f"coalesce((SELECT dot FROM ed WHERE ed.email_id = s.email_id AND ed.label = '{c}'), 0.0) + (SELECT intercept FROM prior WHERE label = '{c}')"
    for c in ("phishing", "safe", "spam")) + """] AS z FROM surv s),
ee AS (SELECT email_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM ez),
ep AS (SELECT email_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM ee),
""" + DECIDE_SQL.lstrip(", \n").replace("FROM pr3", "FROM ep").replace("doc_id", "email_id") + """,
ec AS (SELECT e.email_id, e.term, e.value * w.weight AS c FROM ef e JOIN dec ON dec.email_id = e.email_id
  JOIN wt w ON w.ns = e.ns AND w.term = e.term AND w.label = dec.raw_label WHERE e.value * w.weight > 0),
er AS (SELECT email_id, string_agg(term, ', ' ORDER BY rn) AS reasons, sum(c) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY round(c, 9) DESC, term) AS rn FROM ec) WHERE rn <= 6 GROUP BY email_id)
SELECT p0.doc_id + 1 AS id, dec.label, dec.raw_label, dec.fallback_reason, round(dec.prob, 6) AS confidence,
  coalesce(er.reasons, '') AS reasons, round(coalesce(er.weight, 0.0), 6) AS reason_weight
FROM p0 JOIN dec ON dec.email_id = p0.email_id LEFT JOIN er ON er.email_id = p0.email_id"""


@register("m05_scan_with_model", _SCAN_NB_SQL)
def m05_scan_with_model(spark, sf):
    """M5 with a model: NB fit on the labelled training split, then the batch scan of every
    e-mail of the view scored by it (thresholds applied, top-6 reasons with token and weight)."""
    from mailsieve.operators import features as FE
    from mailsieve.operators.classify import parsed_from_view
    from mailsieve.operators.scans import scan_emails
    from mailsieve.sources.tables import email_view

    s = split_rows(spark, sf).checkpoint()
    tr = s.where(F.col("split") == "train")
    vocab, f_tr, _ = FE.fit_transform(tr, None, max_features={"word": SMALL_CAPS["word"]})
    w, ic = naive_bayes(f_tr, tr, vocab, CLASSES, tasks=FE.size_of(tr)[1])
    w = w.checkpoint()
    scorer = SC.model_scorer(vocab, w, ic, CLASSES, THRESHOLDS)
    scans, _ = scan_emails(parsed_from_view(email_view(spark, sf)), scorer=scorer, model_version="nb-word")
    weight = F.aggregate("details.reasons", F.lit(0.0), lambda a, r: a + r["weight"])
    return scans.select("id", "label", F.col("details.raw_top.label").alias("raw_label"),
                        F.col("details.fallback_reason").alias("fallback_reason"), F.round("confidence", 6).alias("confidence"),
                        "reasons", F.round(weight, 6).alias("reason_weight"))
