import random

from pyspark.sql import functions as F

from mailsieve.operators import neardup as N


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(30)}" for _ in range(n))


def test_sets_and_signatures_are_those_of_the_columns(spark):
    rnd = random.Random(3)
    texts = [None, "", " A  b\tC ", "one two three four five", "x " * 400, "Ünï \U0001f600 code points in a row of words", *(words(rnd, n) for n in (4, 5, 90))]
    df = spark.createDataFrame([*enumerate(texts), (None, "no key")], "doc_id long, body_text string").repartition(2)
    plain = df.where("doc_id IS NOT NULL").select("doc_id", N.shingle_set(F.coalesce("body_text", F.lit(""))).alias("s"))
    want = {r["doc_id"]: (set(r["s"]), r["sig"]) for r in plain.select("doc_id", "s", N.minhash_signature(F.col("s"), 8).alias("sig")).collect()}
    got = N.signed_sets(df, "doc_id", "body_text", num_hashes=8).collect()
    assert len(got) == len(want) and {r["doc_id"]: (set(r["__set"]), r["__sig"]) for r in got} == want
    assert all(len(set(r["__set"])) == len(r["__set"]) for r in got)


def _one_by_one(sets, bands, threshold):
    """The links of every band, its smallest document left first; a key of several sets goes on unless all pairs of sets are alike."""
    links = set()
    for keys in bands:
        rest = sorted(set(keys))
        while len(rest) > 1:
            first, on = rest[0], []
            for k in rest[1:]:
                like = [len(a & b) / len(a | b) >= threshold for a in sets[first] for b in sets[k]]
                if any(like):
                    links.add((first, k))
                if not all(like):
                    on.append(k)
            rest = on
    return links


def test_many_unlike_documents_of_a_band_need_few_rounds(spark, monkeypatch):
    rnd = random.Random(5)
    sets = {}
    for i in range(90):
        # a third are like one of a few others, the rest like none; some keys have two sets
        base = set(range(100 * (i % 30), 100 * (i % 30) + 20)) if i % 3 == 0 else set(range(10000 + 50 * i, 10000 + 50 * i + 20))
        sets[i] = [base - {min(base) + rnd.randrange(20)}] + ([set(range(100 * (i % 7 * 3), 100 * (i % 7 * 3) + 20))] if i % 10 == 0 else [])
    bands = {1: list(range(90)), 2: list(range(0, 90, 3)), 3: [5, 5], 4: [7], 5: [88, 89, 0]}
    at = spark.createDataFrame([(k, sorted(s)) for k, ss in sets.items() for s in ss], "doc_id long, __set array<bigint>")
    banded = spark.createDataFrame([(k, b) for b, ks in bands.items() for k in ks], "doc_id long, band long")
    rounds = []
    plain = type(at).isEmpty
    monkeypatch.setattr(type(at), "isEmpty", lambda self: rounds.append(1) or plain(self))
    N.checkpoint_dir(spark)
    got = {tuple(r) for r in N.verified_links(at, banded, "doc_id").distinct().collect()}
    assert got == _one_by_one(sets, bands.values(), N.THRESHOLD) and got
    assert len(rounds) <= 6  # a round for each leader before
