"""Statistics and weights made in the tasks against the long rows of term counts."""

import pyarrow as pa
from pyspark.sql import functions as F

from mailsieve.operators import features as FE

ROWS = [(1, "alpha beta beta gamma 中é𝒳 alpha"), (1, "beta delta"), (2, None), (3, ""), (None, "alpha zeta"), (None, "beta"), (4, "alpha  beta\tgamma")]


def test_stats_and_values_match_the_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, body_text string")
    counts = FE.terms(docs, use_char=True)
    plain = {tuple(r) for r in FE.term_stats(counts).select("ns", "term", "df", "cf").collect()}
    assert {tuple(r) for r in FE.text_stats(docs, use_char=True).select("ns", "term", "df", "cf").collect()} == plain
    vocab = FE.fit_vocabulary(counts, 7, max_features={"word": 5, "char": 12}).checkpoint()

    def rows(df):
        return sorted((str(r["doc_id"]), r["ns"], r["term"], round(r["value"], 9)) for r in df.collect())

    found = rows(FE.transform_texts(docs, vocab, use_char=True))
    assert found and found == rows(FE.transform(counts, vocab))


def test_a_task_adds_up_its_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["alpha beta"] * 500), pa.array(["abcd"] * 500)], ["key", "w", "c"])
    # 3 words terms and 3 character terms, whatever the number of texts
    assert sum(len(x) for x in FE._count_stats((1, 2), (3, 5), ())([batch])) == 6


def test_values_leave_the_task_weighed(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(40)], "doc_id long, body_text string")
    _, f, _ = FE.fit_transform(docs, None, max_features={"word": 2})
    f.groupBy("doc_id").agg(F.sum("value")).collect()
    plan = f._jdf.queryExecution().executedPlan().toString()
    # no window over the entries of a document: entries are not shuffled
    assert "Window" not in plan and "MapInArrow" in plan.split("Exchange hashpartitioning")[0]


def test_word_grams_keep_every_text_and_stop_word(spark):
    import regex

    from mailsieve.functions.constants import ENGLISH_STOP_WORDS

    texts = ["the the", None, "", "a b c", "meet the team at the big big room", "Ünï_9 \U0001f600 x the ünï_9 big room", "the"]
    token = regex.compile(FE.WORD_TOKEN)
    for limits in ((1, 2), (1, 3), (2, 2)):
        got = {(int(r), terms[int(w)].as_py(), int(tf)) for at, terms, which, tf0 in FE._word_grams(texts, limits, token, frozenset(ENGLISH_STOP_WORDS))
               for r, w, tf in zip(at, which, tf0)}
        want = set()
        for i, t in enumerate(texts):
            kept = [x for x in token.findall(t or "") if x not in ENGLISH_STOP_WORDS]
            grams = [" ".join(kept[k:k + n]) for n in range(limits[0], limits[1] + 1) for k in range(len(kept) - n + 1)]
            want |= {(i, g, grams.count(g)) for g in grams}
        assert got == want


def test_fit_counts_every_namespace_once_in_tasks_of_a_bounded_size(spark, monkeypatch):
    counted, weighed = [], []
    stats, weigh = FE._count_stats, FE._weigh_texts
    monkeypatch.setattr(FE, "_count_stats", lambda *a: counted.append(a[:2]) or stats(*a))
    monkeypatch.setattr(FE, "_weigh_texts", lambda *a: weighed.append(a) or weigh(*a))
    monkeypatch.setattr(FE, "TASK_BYTES", 100)
    docs = spark.createDataFrame([(i, f"text {i} of some words {i % 5}") for i in range(200)], "doc_id long, body_text string").checkpoint()
    n, tasks = FE.size_of(docs)
    assert n == 200 and tasks > 30
    vocab, f, _ = FE.fit_transform(docs, None, use_char=True, max_features={"word": 50, "char": 50})
    # the word n-grams for the words' cap, the characters' for theirs; before, both for each
    assert counted == [(FE.WORD_NGRAM_RANGE, None), (None, FE.CHAR_NGRAM_RANGE)] and len(weighed) == 1
    plan = f._jdf.queryExecution().toString()
    assert f", {tasks})" in plan and "REPARTITION_BY_NUM" in plan
    whole = {tuple(r) for r in FE.cap_vocabulary(FE.text_stats(docs, use_char=True), n, {"word": 50, "char": 50}).collect()}
    assert {tuple(r) for r in vocab.collect()} == whole and len(whole) == 100
    plain = {(r["doc_id"], r["ns"], r["term"]): r["value"] for r in FE.transform(FE.terms(docs, use_char=True), vocab).collect()}
    got = {(r["doc_id"], r["ns"], r["term"]): r["value"] for r in f.collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-12 for k in got)


def test_naive_bayes_makes_the_features_once(spark):
    from mailsieve.operators.train import naive_bayes

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(i, "word", f"t{i % 3}", 0.5 + i % 4) for i in range(40)]
    features = spark.createDataFrame(rows, "doc_id long, ns string, term string, value double").mapInArrow(seen, "doc_id long, ns string, term string, value double")
    labels = spark.createDataFrame([(i, ("phishing", "safe", "spam")[i % 3 if i % 5 else 0]) for i in range(40)], "doc_id long, label string")
    vocab = spark.createDataFrame([("word", f"t{k}") for k in range(3)], "ns string, term string")
    weights, _ = naive_bayes(features, labels, vocab, tasks=11)
    assert weights.count() == 9 and made.value == 40


def test_training_rows_drop_white_space_only(spark):
    from mailsieve.operators.corpus import training_rows

    texts = [" a ", "\n", "  \t", "", None, "  ", "x\n", " y z ", "​"]
    df = spark.createDataFrame([(i, t, "ham") for i, t in enumerate(texts)], "doc_id long, body_text string, label string")
    assert {r["doc_id"]: r["body_text"] for r in training_rows(df).collect()} == {0: "a", 6: "x", 7: "y z", 8: "​"}
