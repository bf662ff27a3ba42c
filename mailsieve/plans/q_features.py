"""Plans for tokenisers and TF-IDF.

Fit set: the training split (M6) of the labelled corpus; features are
computed for the training docs and, with the same vocabulary, for the
validation docs.  Per-document results are summarised (term count, sum and
max of values) so the comparison stays compact; the vocabulary is listed in full.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.functions import text as T
from mailsieve.functions.constants import ENGLISH_STOP_WORDS
from mailsieve.operators import features as FE
from mailsieve.operators import metrics as M
from mailsieve.operators.corpus import training_rows
from mailsieve.plans.registry import register
from mailsieve.plans.sqlviews import CORPUS_VIEW, TRAIN_VIEW
from mailsieve.session import checkpoint_dir, read_table
from mailsieve.sources.tables import corpus_view

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS) + "]"
WORD_RE = r"[\p{L}\p{N}_]{2,}"
SMALL_CAPS = {"word": 20000, "char": 10000}


def split_rows(spark, sf):
    checkpoint_dir(spark)
    rows = training_rows(corpus_view(spark, sf))
    return M.stratified_split(rows.select("doc_id", "body_text", "label"), "doc_id", "label", 0.2, 42, stratify=True)


QUOTA_SQL = """q AS (SELECT label, floor(n * 0.2) + CASE WHEN row_number() OVER (ORDER BY round(n * 0.2 - floor(n * 0.2), 9) DESC, label) <=
    ceil(round(sum(n) OVER () * 0.2, 9)) - sum(floor(n * 0.2)) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT label, count(*) AS n FROM %s GROUP BY label))"""
SPLIT_SQL = f"""WITH {CORPUS_VIEW}, {TRAIN_VIEW}, {QUOTA_SQL % 'train'}, split AS (
  SELECT doc_id, r.label, body_text, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM train) r
  JOIN q ON r.label = q.label)"""

WORD_SQL = f""", tok AS (
  SELECT doc_id, split, list_filter(regexp_extract_all(lower(body_text), '{WORD_RE}'), lambda t: NOT list_contains({STOP_SQL}, t)) AS toks
  FROM split
), wg AS (
  SELECT doc_id, split, unnest(toks) AS term FROM tok
  UNION ALL SELECT doc_id, split, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM tok
), wtf AS (SELECT doc_id, split, 'word' AS ns, term, count(*) AS tf FROM wg GROUP BY doc_id, split, term)"""

CHAR_SQL = r""", cp AS (SELECT doc_id, split, regexp_replace(lower(body_text), '\s\s+', ' ', 'g') AS t FROM split),
cg AS (SELECT doc_id, split, unnest(list_transform(range(1, length(t) - nn.n + 2), lambda i: substr(t, i, nn.n))) AS term
  FROM cp, (SELECT unnest([3, 4, 5]) AS n) nn),
ctf AS (SELECT doc_id, split, 'char' AS ns, term, count(*) AS tf FROM cg GROUP BY doc_id, split, term)"""


def vocab_sql(with_char: bool) -> str:
    allt = "SELECT * FROM wtf" + (" UNION ALL SELECT * FROM ctf" if with_char else "")
    char_part = (" UNION ALL (SELECT * FROM st WHERE ns = 'char' ORDER BY cf DESC, term ASC LIMIT 10000)"
                 if with_char else "")
    return f""", alltf AS ({allt}),
nd AS (SELECT count(*) AS n FROM split WHERE split = 'train'),
st AS (SELECT ns, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM alltf WHERE split = 'train' GROUP BY ns, term),
capped AS ((SELECT * FROM st WHERE ns = 'word' ORDER BY cf DESC, term ASC LIMIT 20000){char_part}),
vocab AS (SELECT ns, term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM capped, nd),
fw AS (SELECT t.doc_id, t.split, t.ns, t.term, (1.0 + ln(t.tf)) * v.idf AS w FROM alltf t JOIN vocab v ON t.ns = v.ns AND t.term = v.term),
feat AS (SELECT doc_id, split, ns, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, ns)) AS value FROM fw)"""


FEAT_WORD_SQL = SPLIT_SQL + WORD_SQL + vocab_sql(False)
FEAT_ALL_SQL = SPLIT_SQL + WORD_SQL + CHAR_SQL + vocab_sql(True)

_SUMMARY = """ SELECT doc_id, ns, count(*) AS n_terms, round(sum(value), 6) AS sum_value, round(max(value), 6) AS max_value
FROM feat WHERE split = '{split}' GROUP BY doc_id, ns"""


def _fit(spark, sf, use_char):
    s = split_rows(spark, sf).checkpoint()  # the texts are read again for every count
    tr = s.where(F.col("split") == "train")
    va = s.where(F.col("split") == "val")
    caps = SMALL_CAPS if use_char else {"word": SMALL_CAPS["word"]}
    return FE.fit_transform(tr, va, use_char=use_char, max_features=caps)


def _summary(f):
    return f.groupBy("doc_id", "ns").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("value"), 6).alias("sum_value"),
                                         F.round(F.max("value"), 6).alias("max_value"))


@register("h23_word_ngrams", f"""WITH tok AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{WORD_RE}'), lambda t: NOT list_contains({STOP_SQL}, t)) AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_unigrams, CAST(greatest(len(toks) - 1, 0) AS INTEGER) AS n_bigrams,
  sha256(array_to_string(toks, ' ')) AS tokens_sha FROM tok""")
def h23_word_ngrams(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", T.word_tokens("text").alias("toks"))
    g = T.word_ngrams(F.col("toks"), 2, 2)
    return d.select("doc_id", F.size("toks").cast("int").alias("n_unigrams"), F.size(g).cast("int").alias("n_bigrams"),
                    T.sha256_hex(F.array_join("toks", " ")).alias("tokens_sha"))


@register("h24_char_ngrams", r"""WITH cp AS (SELECT doc_id, regexp_replace(lower(text), '\s\s+', ' ', 'g') AS t FROM documents),
cg AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - nn.n + 2), lambda i: substr(t, i, nn.n))) AS term
  FROM cp, (SELECT unnest([3, 4, 5]) AS n) nn)
SELECT doc_id, count(*) AS n_grams, count(DISTINCT term) AS n_distinct FROM cg GROUP BY doc_id""")
def h24_char_ngrams(spark, sf):
    t = FE.char_terms(read_table(spark, sf, "documents"), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.sum("tf").alias("n_grams"), F.count(F.lit(1)).alias("n_distinct"))


@register("d20_term_stats", FEAT_WORD_SQL + """ SELECT ns, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS sum_df,
  CAST(sum(cf) AS BIGINT) AS sum_cf FROM st GROUP BY ns""")
def d20_term_stats(spark, sf):
    s = split_rows(spark, sf).where(F.col("split") == "train")
    st = FE.term_stats(FE.terms(s))
    return st.groupBy("ns").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").cast("long").alias("sum_df"),
                                F.sum("cf").cast("long").alias("sum_cf"))


@register("f05_vocabulary_cap", FEAT_ALL_SQL + " SELECT ns, term, df, cf, round(idf, 6) AS idf FROM vocab")
def f05_vocabulary_cap(spark, sf):
    v, _, _ = _fit(spark, sf, True)
    return v.select("ns", "term", "df", "cf", F.round("idf", 6).alias("idf"))


@register("h22_tfidf_word", FEAT_WORD_SQL + _SUMMARY.format(split="train"))
def h22_tfidf_word(spark, sf):
    _, tr, _ = _fit(spark, sf, False)
    return _summary(tr)


@register("m08_tfidf_transform_val", FEAT_WORD_SQL + _SUMMARY.format(split="val"))
def m08_tfidf_transform_val(spark, sf):
    _, _, va = _fit(spark, sf, False)
    return _summary(va)


@register("g04_word_char_features", FEAT_ALL_SQL + _SUMMARY.format(split="train"))
def g04_word_char_features(spark, sf):
    _, tr, _ = _fit(spark, sf, True)
    return _summary(tr)
