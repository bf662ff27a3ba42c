"""Operators 11, 12 and 13 against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import divergence as V
from mailsieve.llm import fingerprint as S
from mailsieve.llm import prefixtrie as T


def _lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# --- operator 11 -------------------------------------------------------------------------------------------------

def _audit(docs, min_docs, top):
    n_docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((x or "", y or "", z) for x, y, z in docs):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))
        groups.add((lang, source))
        n_docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in n_docs[lang].items() if n >= min_docs]
        own = [(s, {t: count[x, s][t] for t in kept}) for x, s in groups if x == lang]
        whole = {t: sum(c[t] for _, c in own) for t in kept}

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        q = share(whole)
        for s, c in own:
            p = share(c)
            pairs = [(-sum(abs(p[t] - other[t]) for t in kept), name.encode()) for name, other in ((n, share(x)) for n, x in own) if name != s]
            terms = [(q[t] - p[t], t.encode()) for t in kept if c[t] > 0 and p[t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, name.decode(), -v, rank) for rank, (v, name) in enumerate(rows, 1)}
    return out


def _audit_rows(df, min_docs, top=V.TOP):
    return [tuple(x) for x in V.digest(V.Audit(df, min_docs), top).collect()]


@pytest.mark.parametrize("rows", [V.ROWS, 40])
def test_audit_matches_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(V, "ROWS", rows)
    r = random.Random(2)
    words = ["Ab", "ab", "Été", "été", "x1y", "中文", "z", "foo_bar", "I'm", "rare", "the"]
    docs = [(r.choice(["en", "de", None]), r.choice(["a", "b", "é", None, "A"]), " ".join(r.choice(words[:r.randrange(1, 12)]) for _ in range(r.randrange(30))))
            for _ in range(120)]
    docs += [docs[3]] * 40 + [("en", "only", "!!! 12"), ("xx", "a", "alone"), ("xx", "b", None), ("en", "a", docs[3][2])]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    for min_docs in (1, 8):
        got = _audit_rows(df, min_docs, 3)
        assert len(got) == len(set(got)) and set(got) == _audit(docs, min_docs, 3)


def test_a_text_that_many_documents_share_is_tokenized_once(spark):
    docs = [("en", f"s{i % 3}", "same text of all") for i in range(300)] + [("de", "s0", "same text of all"), ("en", "s0", "another")]
    once = V.collapse(spark.createDataFrame(docs, "lang string, source string, text string")).collect()
    assert sorted((x.lang, x.text, sorted(map(tuple, x.sources))) for x in once) == [
        ("de", "same text of all", [("s0", 1)]), ("en", "another", [("s0", 1)]), ("en", "same text of all", [("s0", 100), ("s1", 100), ("s2", 100)])]


def test_audit_of_odd_rows(edge, nothing):
    got = _audit_rows(edge, 1)
    docs = [(x["lang"], x["source"], x["text"]) for x in edge.collect()]
    assert set(got) == _audit(docs, 1, V.TOP)
    assert _audit_rows(nothing, 1) == []
    assert {x[4] for x in _audit_rows(edge, 100)} <= {0}  # no kept term: pairs of value 0


# --- operator 12 -------------------------------------------------------------------------------------------------

def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(),
                           role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _nodes(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(own) - 1) * len(path[-1][1].encode()) if path else 0
    ends = {path: ",".join(str(c) for c in own if len(convs[c]) == len(path)) for path, own in members.items()}
    return sorted((own[0], len(path), members[path[:-1]][0] if path else None, len(own), kids[path], leaves[path], saved[path],
                   hashlib.sha256(ends[path].encode()).hexdigest()) for path, own in members.items())


def _trie_rows(turns, convs=None):
    return sorted(tuple(x) for x in T.trie(turns, convs).collect())


def _chats(r, n, longest):
    turns = [(role, text) for role in ("user", None, "bot") for text in ("hi", "", None, "é 中", "a longer text")]
    return [(c, r.choice([None, t, t]) if r.random() < 0.1 else t, *r.choice(turns[:4 if t < 3 else 15]))
            for c in range(-6, n) for t in range(r.randrange(1, longest))]


@pytest.mark.parametrize("segment, shard", [(256, 1 << 18), (2, 30), (3, 1)])
def test_trie_matches_brute_force(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(T, "SEGMENT", segment)
    monkeypatch.setattr(T, "SHARD_ROWS", shard)
    monkeypatch.setattr(T, "MEMBERS", 4)
    r = random.Random(5)
    rows = _chats(r, 40, 9) + [(100 + c, t, "user", "same") for c in range(20) for t in range(7)] + [(None, 0, "user", "no conversation"), (7, 3, "bot", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")).repartition(4)
    turns = T.numbered(df)
    plain = defaultdict(list)
    for x in turns.collect():
        plain[x.conv].append(x.pos)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in plain.values())
    got = _trie_rows(*T.rebuilt(turns))
    assert got == _nodes(_rebuilt(rows))


def test_one_very_long_conversation(spark):
    rows = [(1, t, "user", f"turn {t % 7}") for t in range(2000)] + [(2, t, "user", f"turn {t % 7}") for t in range(1500)] + [(3, 0, "user", "other")]
    convs = {c: [x[2:] for x in rows if x[0] == c] for c in (1, 2, 3)}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert _trie_rows(T.numbered(df)) == _nodes(convs)


def test_trie_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert _trie_rows(*T.rebuilt(T.numbered(spark.createDataFrame([], schema)))) == []
    assert _trie_rows(T.numbered(spark.createDataFrame([(None, 1, "a", "b")], schema))) == []
    rows = [(5, None, None, None), (5, None, None, None), (6, 1, "user", "x" * 300_000)]
    convs = {5: [("", ""), ("", "")], 6: [("user", "x" * 300_000)]}
    assert _trie_rows(T.numbered(spark.createDataFrame(rows, schema))) == _nodes(convs)
    none = spark.createDataFrame([(9,), (8,)], "conv long")
    assert _trie_rows(T.numbered(spark.createDataFrame([], schema)), none) == _nodes({8: [], 9: []})


def test_slots_are_minimal_and_verified():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 20_000):
        lo, hi = (r.integers(0, 1 << 63, 2 * n).astype(np.uint64) for _ in range(2))
        table = T.SlotTable(lo[:n], hi[:n])
        assert table.n == n and sorted(table.slots(lo[:n], hi[:n])) == list(range(n))
        assert (table.slots(lo[n:], hi[n:]) == -1).all()  # foreign keys are told by the digest in their slot


def test_two_sequences_with_one_digest_stop_the_job(spark):
    turns = T.numbered(spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "b")], "conv_id long, turn long, role string, text string"))
    segments = T._segments(turns, turns.select("conv").distinct())
    one = F.transform("items", lambda x: x.withField("lo", F.lit(1).cast("long")).withField("hi", F.lit(1).cast("long")))
    with pytest.raises(Exception, match="share a digest"):
        segments.withColumn("items", one).select("conv", "seg", "items", "before_lo", "before_hi").coalesce(1).mapInArrow(T._count_nodes(256, 100), T.NODE_PARTS).count()


# --- operator 13 -------------------------------------------------------------------------------------------------

def _sketch(text, k, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    return sorted({hashlib.md5(x.encode()).hexdigest()[:16] for x in shingles})[:k]


def _alike(a, b, k):
    u = sorted(set(a) | set(b))[:k]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def _edited_rows(docs, k=S.K):
    docs = sorted(((i is not None, i or 0, i, t or "") for i, t in docs), reverse=True)
    out = []
    for (*_, i, t), (*_, nxt) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        a, b, c = (_sketch(x, k) for x in (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(a), "".join(b), _alike(a, b, k), _alike(a, c, k)))
    return sorted(out, key=repr)


def test_fingerprints_match_brute_force(spark):
    r = random.Random(9)
    vocabulary = ["Wort", "mot", "é中", "word", "𝒳y", "и"]
    docs = [(i * 7 % 211, r.choice([" ", "\t", "  \n", "  "]).join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 5, 40, 200])))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "x"), (503, "one two three four five " * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sketch", F.lit("clash")).repartition(4)
    got = sorted((tuple(x) for x in S.digest(S.edited(df)).collect()), key=repr)
    assert got == _edited_rows(docs)


def test_fingerprints_of_odd_rows(spark, edge, nothing):
    rows = edge.select("doc_id", "text").distinct()  # equal keys and texts apart: any order of them is right
    got = sorted((tuple(x) for x in S.digest(S.edited(rows)).collect()), key=repr)
    assert got == _edited_rows([tuple(x) for x in rows.collect()])
    rows = S.digest(S.edited(edge)).collect()
    assert len(rows) == edge.count() and {x.near_next for x in rows if x.doc_id == 1} <= {0.0, 1.0}
    assert S.digest(S.edited(nothing)).count() == 0
    one = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert [x.near_next for x in S.digest(S.edited(one)).collect()] == [1.0]


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(6000)]
    texts = {"a": words[:4000], "b": words[2000:6000], "c": words[:1000], "d": words[5000:5003], "e": []}
    df = spark.createDataFrame([(n, " ".join(w)) for n, w in texts.items()], "doc_id string, text string")
    made = S.fingerprints(df, k=256)
    got = {x.doc_id: x for x in made.collect()}
    assert all(got[n].sketch == _sketch(" ".join(w), 256) for n, w in texts.items())
    assert got["d"].n_shingles == 1 and got["e"].n_shingles == 0 and abs(got["a"].n_shingles - 3996) < 0.25 * 3996
    pair = made.alias("x").join(made.alias("y"), F.expr("x.doc_id < y.doc_id"))
    near = {(x[0], x[1]): x[2:] for x in pair.select("x.doc_id", "y.doc_id", S.resemblance(F.col("x.sketch"), F.col("y.sketch"), 256),
                                                     S.containment(F.col("y.sketch"), F.col("x.sketch"), 256)).collect()}
    assert abs(near["a", "b"][0] - 1 / 3) < 0.1 and abs(near["a", "b"][1] - 0.5) < 0.15
    assert abs(near["a", "c"][0] - 0.25) < 0.1 and near["a", "c"][1] > 0.75 and near["a", "e"] == (0.0, 1.0)
    # parts that overlap by a shingle less one word merge to the whole
    parts = [("a", " ".join(texts["a"][i:i + 504])) for i in range(0, 4000, 500)] + [("e", None), ("e", "")]
    parts = spark.createDataFrame(parts, "name string, text string").withColumn("sketch", S.sketch(F.col("text"), 256))
    merged = {x.name: x.sketch for x in S.merge_sketches(parts, ["name"], k=256).collect()}
    assert merged == {"a": got["a"].sketch, "e": []}
    assert spark.range(1).select(S.to_sketch(F.lit("".join(got["a"].sketch)))).collect()[0][0] == got["a"].sketch
