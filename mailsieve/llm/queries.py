"""One query per operator, over whole tables with production parameters, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import ctw, decontaminate, divergence, fingerprint, kneserney, langid, linededup, packing, prefixtrie, secrets, simhash, topk, urlfilter
from mailsieve.session import read_table

#: the tokenizer file of the packing query
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


OP1_SQL = r"""
WITH lowered AS (SELECT 'b' AS kind, item_id AS id, 0 AS row_no, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark
  UNION ALL SELECT 'd', doc_id, row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents),
tokens AS (SELECT kind, id, row_no, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
item_windows AS (SELECT DISTINCT id AS item_id, least(len(w), 10) AS k,
    array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM tokens WHERE kind = 'b' AND len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (SELECT id, row_no, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT id, row_no, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM tokens, lengths WHERE kind = 'd' AND len(w) >= k)),
hits AS (SELECT row_no, d.k AS k, i, item_id FROM doc_windows d JOIN item_windows b ON d.k = b.k AND d.win = b.win),
words AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + k)) AS p FROM hits) GROUP BY row_no),
items AS (SELECT row_no, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM (SELECT DISTINCT row_no, item_id FROM hits) GROUP BY row_no)
SELECT t.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tokens t LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no) WHERE kind = 'd'
"""


@query(OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")))


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


#: the rules of the URL filter query, as (host, path, verdict)
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))

OP8_SQL = """
WITH rules(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS row_no,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, row_no, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT row_no, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY row_no ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (row_no)
"""


@query(OP8_SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlfilter.digest(urlfilter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules))


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


OP2_SQL = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


@query(OP2_SQL)
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(langid.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True))


@query()
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    trusted = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    return kneserney.classify(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), trusted)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, lead(t) OVER w AS after, first_value(t) OVER w AS first FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (SELECT doc_id, t, coalesce(after, first) AS nt, substr(t, 1, length(t) - length(t) // 2) || substr(coalesce(after, first), 1, length(t) // 2) AS et FROM n),
x AS (SELECT *, list_transform([t, et, nt], lambda s: list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS ws FROM e),
h AS (SELECT doc_id, t, et, list_transform(ws, lambda w: list_sort(list_distinct(list_transform(
  CASE WHEN len(w) = 0 THEN CAST([] AS BIGINT[]) ELSE range(1, greatest(len(w) - 4, 1) + 1) END,
  lambda i: md5(array_to_string(list_slice(w, i, i + 4), ' '))[1:16])))[1:64]) AS s FROM x),
u AS (SELECT *, list_sort(list_distinct(list_concat(s[1], s[2])))[1:64] AS ue, list_sort(list_distinct(list_concat(s[1], s[3])))[1:64] AS un FROM h)
SELECT doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256, array_to_string(s[1], '') AS fingerprint, array_to_string(s[2], '') AS edited_fingerprint,
  CASE WHEN len(ue) = 0 THEN 1.0 ELSE len(list_filter(ue, lambda y: list_contains(s[1], y) AND list_contains(s[2], y))) / len(ue) END AS near_edited,
  CASE WHEN len(un) = 0 THEN 1.0 ELSE len(list_filter(un, lambda y: list_contains(s[1], y) AND list_contains(s[3], y))) / len(un) END AS near_next
FROM u
"""


@query(OP13_SQL)
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(fingerprint.edited(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS l, coalesce(source, '') AS s,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, l, s, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d),
c AS (SELECT l, s, w, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY l, s, w),
k AS (SELECT l, w, sum(n) AS total FROM c GROUP BY l, w HAVING sum(docs) >= 30),
v AS (SELECT l, count(*) AS v, sum(total) AS ln FROM k GROUP BY l),
gn AS (SELECT l, s, sum(n) AS gn FROM c JOIN k USING (l, w) GROUP BY l, s),
g AS (SELECT l, s, coalesce(gn, 0) AS gn, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln
  FROM (SELECT DISTINCT l, s FROM d) LEFT JOIN gn USING (l, s) LEFT JOIN v USING (l)),
p AS (SELECT g.l AS l, g.s AS s, k.w AS w, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (gn + 5 * v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (total + 5)) // (ln + 5 * v) AS q
  FROM g JOIN k ON g.l = k.l LEFT JOIN c ON c.l = g.l AND c.s = g.s AND c.w = k.w),
pairs AS (SELECT a.l AS l, a.s AS s, b.s AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.l = b.l AND a.w = b.w AND a.s <> b.s GROUP BY a.l, a.s, b.s),
ways AS (SELECT a.l AS l, a.s AS s, b.s AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.l = b.l AND a.s <> b.s LEFT JOIN pairs x ON x.l = a.l AND x.s = a.s AND x.item = b.s),
found AS (SELECT l, s, 'pair' AS part, item, value FROM ways UNION ALL SELECT l, s, 'term', w, p - q FROM p WHERE n > 0 AND p > q)
SELECT l AS lang, s AS source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l, s, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 50
"""


@query(OP11_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.digest(divergence.Audit(read_table(spark, sf_dir, "documents").select("text", "lang", "source")))


OP12_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
hs AS (SELECT c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h FROM ids),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT hs.c AS c, 0 AS part, pos, role, text FROM hs JOIN t ON t.c = hs.c - hs.c % 5 AND pos <= h
  UNION ALL SELECT t.c, 1, pos, role, text FROM t JOIN hs ON t.c = hs.c AND pos > h),
p AS (SELECT c, row_number() OVER w AS d, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path, strlen(text) AS b FROM r
  WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
members AS (SELECT c, d, path, b FROM p UNION ALL SELECT c, 0, '', 0 FROM ids),
nodes AS (SELECT path, d, min(c) AS c, count(*) AS n, max(b) AS b FROM members GROUP BY path, d),
kids AS (SELECT path[1:32 * (d - 1)] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
sums AS (SELECT v.path AS path, sum((u.n - 1) * u.b) AS saved, count(*) FILTER (WHERE u.n_children = 0) AS leaves
  FROM full_nodes v JOIN full_nodes u ON starts_with(u.path, v.path) GROUP BY v.path),
ends AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM (
  SELECT c, path, row_number() OVER (PARTITION BY c ORDER BY d DESC) AS k FROM members) WHERE k = 1 GROUP BY path)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, n.n_children AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.path = n.path[1:32 * (n.d - 1)]
LEFT JOIN ends e ON e.path = n.path
"""


@query(OP12_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefixtrie.rebuilt(prefixtrie.numbered(read_table(spark, sf_dir, "conversations")))
    return prefixtrie.trie(turns, convs)
