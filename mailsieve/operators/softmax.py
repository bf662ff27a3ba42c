"""M9: class-weighted softmax regression by mini-batch AdamW, as DataFrame steps.

The model is a table (ns, term, w, m, v): per term an array of weights, one a class, and the
optimiser's two moments; the bias is the term '' of the namespace BIAS, which every document has
with value 1.  One step over a batch of documents is

    logits    sum(value * w) over a document's rows (a window on rows that stay partitioned and sorted by document)
    gradient  sum(value * weight * (p - 1[label])) / sum(weight), by (ns, term): combined in the tasks, then shuffled
    update    w, m, v of every term (decoupled weight decay, also where the gradient is 0)

so neither features nor coefficients pass through the driver, and there are no vectors or UDFs.

Batches are fixed by a hash of seed and key.  Weights start at 0, so a run is determined by its
input and parameters.  After every epoch the validation rows are scored; the state of the first epoch
with the best score is the result.

Scale: the training rows are written once by batch and then once more partitioned and sorted
by document, so a step reads its own batch and shuffles only gradients (at most one row a term and task).  The state is
one row a term: it is written every step (lineage stays one step long), and broadcast while it is
below BROADCAST_BYTES, beyond that joined by a shuffle.

Rows with a null key or a label outside ``classes`` take no part.  A document without features
has only the bias.  A batch without documents is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.constants import CLASSES, SPLIT_SEED
from mailsieve.operators import metrics as M
from mailsieve.session import checkpoint_dir

BIAS = "bias"
BROADCAST_BYTES = 64 << 20
BETAS, EPSILON = (0.9, 0.999), 1e-8


def batch_of(key: str, seed: int, batches: int) -> Column:
    """Batch number of a key, the same on every run."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(batches)).cast("int")


def _numbers(values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def _rows(features: DataFrame, labels: DataFrame, key: str, classes) -> DataFrame:
    """(key, ns, term, value, y, weight, batch): the features and the bias of every labelled document."""
    own = labels.withColumn("y", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1)
    own = own.where(F.col(key).isNotNull() & (F.col("y") >= 0)).select(key, "y", "weight", "batch")
    bias = own.select(key, F.lit(BIAS).alias("ns"), F.lit("").alias("term"), F.lit(1.0).alias("value"), "y", "weight", "batch")
    return features.select(key, "ns", "term", "value").join(own, key).unionByName(bias)


def _with_weights(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    w = state.select("ns", "term", "w")
    return rows.join(F.broadcast(w) if small else w, ["ns", "term"])


def _gradient(rows: DataFrame, state: DataFrame, total: float, key: str, k: int, small: bool) -> DataFrame:
    by = Window.partitionBy(key)
    x = _with_weights(rows, state, small)
    x = x.select(key, "ns", "term", "value", "y", "weight", _numbers([F.sum(F.col("value") * F.col("w")[i]).over(by) for i in range(k)]).alias("z"))
    x = x.withColumn("p", M.softmax(F.col("z")))
    share = F.col("value") * F.col("weight") / F.lit(total)
    sums = [F.sum(share * (F.col("p")[i] - F.when(F.col("y") == i, 1.0).otherwise(0.0))).alias(f"g{i}") for i in range(k)]
    return x.groupBy("ns", "term").agg(*sums)


def _update(state: DataFrame, gradient: DataFrame, t: int, k: int, lr: float, weight_decay: float) -> DataFrame:
    b1, b2 = BETAS
    g = _numbers([F.coalesce(F.col(f"g{i}"), F.lit(0.0)) for i in range(k)])
    x = state.join(gradient, ["ns", "term"], "left").withColumn("g", g)
    x = x.withColumn("m", F.zip_with("m", "g", lambda m, g: m * b1 + g * (1 - b1))).withColumn(
        "v", F.zip_with("v", "g", lambda v, g: v * b2 + g * g * (1 - b2)))
    move = F.zip_with("m", "v", lambda m, v: (m / (1 - b1 ** t)) / (F.sqrt(v / (1 - b2 ** t)) + EPSILON))
    return x.select("ns", "term", F.zip_with("w", move, lambda w, d: w * (1 - lr * weight_decay) - d * lr).alias("w"), "m", "v")


def _partitioned(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows written once, partitioned and sorted by key in a way that later plans know of (an adaptive plan doesn't tell)."""
    conf, name = rows.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return rows.repartition(n, key).sortWithinPartitions(key).checkpoint()
    finally:
        conf.set(name, before)


def macro_recall_score(scored: DataFrame, classes) -> float:
    """Mean recall over the classes of (y, pred), the multiclass selection score."""
    return M.macro_recall(scored, "y", "pred", list(classes)).first()["macro_recall"] or 0.0


def f2_score(scored: DataFrame, classes) -> float:
    """F2 at the threshold tuned for it, the binary selection score (second class in ``classes`` order: not_safe first)."""
    positive = list(classes).index("not_safe")
    ev = scored.select((F.col("y") == "not_safe").cast("int").alias("y"), F.col("p")[positive].alias("p"))
    threshold = M.tune_threshold(ev, "p", "y", "f2").first()["threshold"]
    return M.binary_fbeta_at(ev, "p", "y", threshold, 2.0).first()["fbeta"] or 0.0


def predict(features: DataFrame, labels: DataFrame, state: DataFrame, classes, key: str, small: bool = True) -> DataFrame:
    """(key, y, pred, p) of labelled documents; ties go to the first class."""
    x = _with_weights(_rows(features, labels, key, classes), state, small)
    z = x.groupBy(key, "y").agg(_numbers([F.sum(F.col("value") * F.col("w")[i]) for i in range(len(classes))]).alias("z"))
    names = F.array(*[F.lit(c) for c in classes])
    p = z.select(key, names[F.col("y").cast("int")].alias("y"), M.softmax(F.col("z")).alias("p"))
    return p.withColumn("pred", names[(F.array_position("p", F.array_max("p")) - 1).cast("int")])


def train(features: DataFrame, labels: DataFrame, vocab: DataFrame, val_features: DataFrame, val_labels: DataFrame, *,
          classes=CLASSES, epochs: int = 10, batches: int = 8, lr: float = 0.05, weight_decay: float = 1e-4,
          class_weight: str = "balanced", seed: int = SPLIT_SEED, score=macro_recall_score, key: str = "doc_id") -> dict:
    """Fit on long features (key, ns, term, value) and labels (key, label).

    Returns ``weights`` (ns, term, label, weight), ``intercepts``, ``state`` (of the best epoch), ``last`` (of the
    last epoch), ``history`` [(epoch, score)] and ``best_epoch``.
    """
    spark = labels.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/softmax-{uuid.uuid4().hex}"
    k, n = len(classes), int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = labels.select(key, "label").where(F.col("label").isin(*classes) & F.col(key).isNotNull())
    weighted = M.with_sample_weight(known, M.class_weights(known, "label", class_weight))
    weighted = weighted.withColumn("batch", batch_of(key, seed, batches))
    rows = _rows(features, weighted, key, classes)
    rows.write.partitionBy("batch").parquet(f"{folder}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    parts = [_partitioned(stored.where(F.col("batch") == b), key, n) for b in range(batches)]
    # one number a batch
    totals = {r["batch"]: r["total"] for r in stored.where(F.col("ns") == BIAS).groupBy("batch").agg(F.sum("weight").alias("total")).collect()}
    held = val_labels.select(key, "label").withColumn("weight", F.lit(1.0)).withColumn("batch", F.lit(0))
    held_features = val_features.select(key, "ns", "term", "value").checkpoint()
    zero = _numbers([0.0] * k)
    terms = vocab.select("ns", "term").unionByName(spark.range(1).select(F.lit(BIAS).alias("ns"), F.lit("").alias("term")))
    state = terms.select("ns", "term", *[zero.alias(c) for c in ("w", "m", "v")]).checkpoint()
    small = state.agg(F.sum(F.length("term") + 8 * k + 32)).first()[0] < BROADCAST_BYTES
    history, best, t = [], (None, None), 0
    for epoch in range(1, epochs + 1):
        for b in range(batches):
            if totals.get(b):
                t += 1
                state = _update(state, _gradient(parts[b], state, totals[b], key, k, small), t, k, lr, weight_decay).checkpoint()
        history.append((epoch, score(predict(held_features, held, state, classes, key, small), classes)))
        if best[0] is None or history[-1][1] > best[0]:
            best = (history[-1][1], state)
    best_epoch = next((e for e, s in history if s == best[0]), None)
    return {**model_tables(best[1] if best_epoch else state, classes), "state": best[1], "last": state, "history": history, "best_epoch": best_epoch}


def model_tables(state: DataFrame, classes) -> dict:
    """The state in the format that ``score.predict`` reads: weights (ns, term, label, weight) and intercepts."""
    names = F.array(*[F.lit(c) for c in classes])
    each = state.select("ns", "term", F.posexplode("w").alias("i", "weight")).select("ns", "term", names[F.col("i")].alias("label"), "weight")
    bias = {r["label"]: r["weight"] for r in each.where(F.col("ns") == BIAS).collect()}  # one number a class
    return {"weights": each.where(F.col("ns") != BIAS), "intercepts": bias}
