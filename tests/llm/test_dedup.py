"""Operators 3 and 7 against brute force, and on odd rows."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from mailsieve.llm import linededup as L
from mailsieve.llm import simhash as H
from mailsieve.operators.components import connected_components


def _components(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_match_brute_force(spark):
    r = random.Random(1)
    vocabulary = ["Wort", "mot", "palabra", "word", "слово", "é"]
    docs = [(i, r.choice((" ", "\t", "  \n")).join(r.choice(vocabulary) for _ in range(r.randrange(0, 40)))) for i in range(80)]
    docs += [(100 + i, docs[i % 5][1] + " extra" * (i % 2)) for i in range(20)] + [(200, None), (201, ""), (200, None)]
    fps = {i: _fingerprint(t) for i, t in docs}
    ids = sorted(fps)
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    root = _components(ids, near)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {tuple(x) for x in H.digest(H.near_duplicates(df)).collect()}
    assert got == {(i, f"{fps[i]:016x}", root[i]) for i in ids}
    assert H.near_duplicates(df).count() == len(docs)  # repeated rows stay


def test_links_in_blocks_of_any_size(spark):
    r = random.Random(3)
    for max_bits in (2, 1):
        fps = set()
        for _ in range(2):
            base = r.getrandbits(64)
            for _ in range(150):
                x = base
                for _ in range(r.randint(0, 4)):
                    x ^= 1 << r.randrange(64)
                fps.add(x)
        fps |= {r.getrandbits(64) for _ in range(50)}
        a = np.sort(np.array(sorted(fps), np.uint64).view(np.int64)).tolist()
        near = [(x, y) for x in a for y in a if x < y and ((x ^ y) & (2**64 - 1)).bit_count() <= max_bits]
        expected = _components(a, near)
        df = spark.createDataFrame([(x,) for x in a], "fp long")
        for block in (64, 4):  # small blocks only, and blocks that are blocked again
            found = H.links(df, max_bits, block).checkpoint()
            assert all(((x.src ^ x.dst) & (2**64 - 1)).bit_count() <= max_bits for x in found.collect())
            got = {x.node: x.root for x in connected_components(found).collect()}
            assert {x: got.get(x, x) for x in a} == expected


def test_one_of_each_group_stays(edge, nothing):
    kept = H.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    ids = [x["doc_id"] for x in rows]
    assert ids.count(1) == 1 and 7 not in ids  # repeated row and copy
    assert sum(i in ids for i in (2, 3, 4)) == 1  # no words: one group
    assert None in ids and 5 in ids and 8 in ids
    assert H.drop_near_duplicates(nothing).count() == 0 and H.near_duplicates(nothing).count() == 0


def _reference(docs, min_words=L.MIN_WORDS):
    """The texts without the lines of blocks that an earlier document has, from all pairs of documents."""
    gone = _shared_blocks(docs, min_words)
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[i]) for i, t in docs}


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(7)
    lines = [" ".join(r.choice("abcdefgh") for _ in range(r.choice((1, 3, 8, 20)))) for _ in range(60)]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 25)))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + "\nown line number %d of this text" % i) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["text"] for x in L.dedup_lines(df).collect()}
    assert got == _reference(docs)


def test_passages_go_and_clean_lines_stay(spark):
    passage = "\n".join(f"passage line {k} " + " ".join(f"w{k}{j}" for j in range(20)) for k in range(3))
    rows = [(i, f"own start of document {i}\n{passage}\nown end {i}\nlicence line") for i in range(40)] + [(99, "alone\nlicence line")]
    got = {x["doc_id"]: x["text"] for x in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[99] == "alone\nlicence line"
    assert all("passage" not in got[i] and f"own end {i}" in got[i] and "licence line" in got[i] for i in range(1, 40))


def test_blank_lines_do_not_break_a_block(spark):
    lines = [f"short line {k} of it" for k in range(4)]
    rows = [(1, "start\n" + "\n\n".join(lines)), (2, "\n \n".join(lines) + "\nend"), (3, "\n".join(lines))]
    got = {x["doc_id"]: x["text"] for x in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2].split() == ["end"] and got[3] == ""


def test_a_short_block_goes_at_every_size(spark):
    block = "one line of twelve words that is repeated in all the documents"
    for n in (3, 40):
        rows = [(i, f"own line {i}\n{block}") for i in range(n)] + [(1000 + i, block) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {x["doc_id"]: x["text"] for x in L.dedup_lines(df).collect()}
        assert got == {0: rows[0][1]} | {i: f"own line {i}" for i in range(1, n)} | {1000 + i: "" for i in range(n)}


def test_copies_and_other_order_within_a_document_go(spark):
    one, two = ("\n".join(f"{x} line {k} " + " ".join(f"{x}{k}{j}" for j in range(18)) for k in range(3)) for x in "ab")
    rows = [(1, f"unique\n{one}\nmiddle\n{two}"), (2, f"{two}\nown text\n{one}"), (3, f"unique\n{one}\nmine\n{one}\nother\n{two}\n{two}")]
    got = {x["doc_id"]: x["text"] for x in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "own text" and set(got[3].split("\n")) <= {"unique", "mine", "other"}


def test_patience_between_the_anchors():
    a = [{"at": [0], "owner_at": [0]}, {"at": [9], "owner_at": [9]}, {"at": [3, 12], "owner_at": [4, 15]}]
    assert L.patience(a) == [(0, 0), (3, 4), (9, 9), (12, 15)]


def _shared_blocks(docs, min_words):
    """Positions of the lines in a block of ``min_words`` words that any earlier document has too, from all pairs."""
    worded = {i: [(p, x) for p, x in enumerate((t or "").split("\n")) if x.strip()] for i, t in docs}
    out = {i: set() for i in worded}
    for i, mine in worded.items():
        for theirs in (worded[j] for j in worded if j < i):
            places = {}
            for q, (_, x) in enumerate(theirs):
                places.setdefault(x, []).append(q)
            for p in range(len(mine)):
                for q in places.get(mine[p][1], ()):
                    if p and q and mine[p - 1][1] == theirs[q - 1][1]:
                        continue  # the block began before
                    n = 0
                    while p + n < len(mine) and q + n < len(theirs) and mine[p + n][1] == theirs[q + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in mine[p:p + n]) >= min_words:
                        out[i].update(place for place, _ in mine[p:p + n])
    return out


def test_line_dedup_matches_all_pairs(spark):
    r = random.Random(11)
    lines = [" ".join(r.choice("abcdefgh") for _ in range(r.choice((1, 3, 4, 8, 20)))) for _ in range(40)] + [""]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 25)))) for i in range(60)]
    docs += [(100 + i, "a heading\n" + docs[i][1] + "\nown line number %d of this text" % i) for i in range(20)]
    for min_words in (10, 25):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        got = {x["doc_id"]: set(x["__gone"] or ()) for x in L.dedup_lines(df, report=True, min_words=min_words).collect()}
        assert got == _shared_blocks(docs, min_words)


def test_patience_decides(spark, monkeypatch):
    r = random.Random(13)
    lines = [r.randrange(12) for _ in range(40)], [r.randrange(12) for _ in range(40)]
    words = [r.choice((1, 4, 12)) for _ in range(12)]

    def both(a, b, n):
        """Lines of ``a`` in common blocks of ``n`` words, by brute force."""
        out = set()
        for p in range(len(a)):
            for q in range(len(b)):
                k = 0
                while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k]:
                    k += 1
                if sum(words[x] for x in a[p:p + k]) >= n:
                    out |= set(range(p, p + k))
        return out

    assert L.repeated(*lines, words, 10) == both(*lines, 10) != set()
    for _ in range(300):
        a, b = ([r.randrange(r.choice((3, 12))) for _ in range(r.randrange(30))] for _ in range(2))
        assert L.repeated(a, b, words, 10) == both(a, b, 10)
    long = list(range(400))
    assert L.repeated(long[::-1], long, [12] * 400, 10) == set(long)  # in reverse order
    assert L.repeated([0] * 3000, [0], [12], 10) == set(range(3000))
    monkeypatch.setattr(L, "patience", lambda items: [])
    assert L.repeated(*lines, words, 10) == set()  # nothing else deletes


def test_a_line_of_another_document_does_not_split_an_exact_copy(spark):
    lines = [f"line {k} " + " ".join(f"w{k}{j}" for j in range(12)) for k in range(6)]
    rows = [(1, "Heading\nown text of one"), (5, "\n".join([*lines[:3], "Heading", *lines[3:]]))]
    rows += [(7, rows[1][1]), (8, "something else")]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), drop_emptied=True)
    assert {x["doc_id"]: x["text"] for x in got.collect()} == {i: t for i, t in rows if i != 7}


def test_line_dedup_on_odd_rows(edge, nothing):
    got = L.dedup_lines(edge)
    assert got.columns == edge.columns and got.count() == edge.count()
    by_id = {x["doc_id"]: x["text"] for x in got.collect()}
    assert by_id[7] == "" and by_id[1].startswith("the quick") and by_id[2] is None and by_id[4] == " \n\t\n "
    assert L.dedup_lines(edge, drop_emptied=True).where("doc_id = 7").count() == 0
    assert L.dedup_lines(nothing).count() == 0


def test_patience():
    a = [{"at": [0], "owner_at": [5]}, {"at": [1], "owner_at": [6]}, {"at": [2, 4], "owner_at": [7]}, {"at": [3], "owner_at": [1]}]
    assert L.patience(a) == [(0, 5), (1, 6), (2, 7)]
    assert L.patience([]) == []
