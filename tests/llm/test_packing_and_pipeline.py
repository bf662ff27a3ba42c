"""Operator 6 against the tokenizer, and the pipeline against its stages restated."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsieve.llm import bpe
from mailsieve.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_matches_the_tokenizer(tokenizer):
    r = random.Random(1)
    signs = "ab's'tredvml  \n\t 12!?.,ñéß' «²½_ªº\r\x0b"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "中文 ok", "<|endoftext|> x", "a\x1cb", "a\x85b", "it's  'start we've''s I'll", " 's", "'", "x'", "'s", "a" * 3000, " " * 500]
    encoder = bpe.Encoder(PATH)
    got = []
    for first, ids, count in encoder.batch(pa.array(texts)):
        assert first == len(got)
        got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _check_places(rows, capacity):
    by_sequence = {}
    for x in rows:
        by_sequence.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(spark, edge, nothing, tokenizer):
    docs = edge.where("doc_id <> 1 OR doc_id IS NULL").unionByName(edge.where("doc_id = 1").limit(2)).repartition(3)
    rows = P.pack(docs, PATH, with_ids=True).collect()
    expected = []
    for x in docs.collect():
        ids = tokenizer.encode(x["text"] or "", add_special_tokens=False).ids + [2]
        size, at = len(ids) % 1024 or 1024, 0
        for piece in range(-(-len(ids) // 1024)):
            own = np.array(ids[at:at + size], "<u4").tobytes()
            expected.append((x["doc_id"], piece, at, size, zlib.crc32(own), own))
            at, size = at + size, 1024
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, bytes(x.ids)) for x in rows), key=repr) == sorted(expected, key=repr)
    n = _check_places(rows, 1024)
    assert n == -(-sum(x.length for x in rows) // 1024)
    packed = P.sequences(spark.createDataFrame(rows)).collect()
    assert len(packed) == n and sum(len(x["ids"]) for x in packed) == 4 * sum(x.length for x in rows)
    assert P.pack(nothing, PATH).count() == 0


def test_few_sequences_on_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    rows = P.pack(d, PATH).collect()
    assert _check_places(rows, 1024) <= 1.005 * -(-sum(x.length for x in rows) // 1024)


def test_genetic_operators_keep_every_piece():
    r = random.Random(1)
    for _ in range(20):
        supply = {r.randrange(1, 100): r.randrange(1, 50) for _ in range(40)}

        def used(packing):
            total = {}
            for pattern, times in packing.items():
                assert sum(pattern) <= 100 and times > 0
                for s in pattern:
                    total[s] = total.get(s, 0) + times
            return total

        one, two = P.best_fit({}, supply, 100), P.best_fit({}, supply, 100, r)
        child = P.crossover(one, two, supply, 100, r)
        assert used(one) == used(two) == used(child) == supply
        best = P.evolve(supply, 100, 3, [one])[0]
        assert used(best) == supply and P.number_of_bins(best) <= P.number_of_bins(one)
    assert P.best_fit({}, {3: 7}, 10) == {(3, 3, 3): 2, (3,): 1}


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, columns = d, d.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").checkpoint()
        if name != names[-1]:
            assert docs.columns == columns
        seen.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:]))  # a stage only works on what its predecessor kept
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {x.doc_id for x in rows} == seen[-1]
    # against the stages restated
    from tests.llm.test_dedup import _fingerprint, _reference

    texts = {x["doc_id"]: x["text"] for x in d.collect() if x["doc_id"] in seen[0]}
    lines = {i: t for i, t in _reference(list(texts.items())).items() if t.strip() or not (texts[i] or "").strip()}
    assert set(lines) == seen[1]
    fps = {i: _fingerprint(t) for i, t in lines.items()}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            low = min(root[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 2)
            if low < root[a]:
                root[a], changed = low, True
    assert {i for i in root if root[i] == i} == seen[2]


def test_pipeline_on_odd_rows(spark, edge, nothing):
    import corpus_pipeline

    for first in (edge, nothing):
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001").checkpoint()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == first.columns
    extra = edge.select("doc_id", "text", "lang", "source", F.lit(1).alias("ids"), F.lit("x").alias("length"))
    assert P.pack(extra, PATH).count() >= extra.count()
