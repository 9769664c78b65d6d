import hashlib
import random

import pytest
from pyspark.sql import functions as F

from boutwise.llm import pieces, queries

ODD = "ab e  \n\t▁1é漢\U0001f600\x00ßstheing<>/0x.,%!'²½"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(pieces.VOCABULARY)


def odd_texts(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_ids_equal_the_library(vocabulary):
    texts = ["", " ", "  a", "a\nb\n", "▁x", "<s> a</s> <0x0A>", "<unk> x", "a ▁ b", *odd_texts(3000, 60, 1)]
    theirs = vocabulary.library.encode(texts, num_threads=1)
    ids, bounds = vocabulary.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == theirs
    assert vocabulary.decode_all(ids, bounds) == [vocabulary.decode(x) for x in theirs] == vocabulary.library.decode(theirs, num_threads=1)


def test_both_agendas_are_alike(vocabulary):
    segments = [s for s in odd_texts(500, 40, 2) if s and not vocabulary.unknown(s)]
    ids, sizes = vocabulary.merge_all(segments)
    ends = sizes.cumsum()
    assert len(segments) > 20 and [tuple(ids[e - n:e]) for e, n in zip(ends, sizes, strict=True)] == [vocabulary.merge(s) for s in segments]
    assert len(vocabulary.merge_all([])[0]) == 0


def test_windows_join_to_the_whole(vocabulary):
    for text in odd_texts(300, 80, 3):
        parts = pieces.windows(text, 7)
        assert " ".join(parts) == text
        assert vocabulary.encode_all(parts)[0].tolist() == vocabulary.library.encode(text)


def test_any_ids_decode_as_in_the_library(vocabulary):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(700 if rng.random() < 0.7 else 32_000) for _ in range(rng.randrange(12))]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 300_000, "the" * 100_000, " " * 300_000, "漢" * 100_000, "\n" * 300_000, "ab " * 500_000])
def test_very_long_texts(vocabulary, text):
    ids = vocabulary.encode_all(pieces.windows(text))[0].tolist()
    assert ids == vocabulary.library.encode(text) and vocabulary.library.decode(ids) == text


def test_memory_of_segments_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    for k in range(20):
        vocabulary.encode_all([f"word{k} other{k}letters " + "long" * 30])
    assert len(vocabulary.codes) <= 50 and all(len(s) <= pieces.SHORT for s in vocabulary.codes)
    assert len(vocabulary.flat) <= 16 * 50 + 200


def test_query_equals_the_library(spark, both, vocabulary):
    found = {}
    for row in pieces.round_trip(both, window=50).collect():
        assert row.agrees
        found.setdefault(row.doc_id, []).append((row.ids, row.decoded))
    for row in both.collect():
        ids = vocabulary.library.encode(row.text or "")
        assert (ids, vocabulary.library.decode(ids) if ids else "") in found[row.doc_id]
    assert sum(map(len, found.values())) == both.count()


def test_digests(spark, tmp_path, odd, vocabulary):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op13_sentencepiece"](spark, str(tmp_path)).filter("doc_id = 4").collect()
    ids = vocabulary.library.encode("One two three four")
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) for r in rows] == [(
        len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"One two three four").hexdigest(), True)]


def test_empty_table(empty):
    assert pieces.round_trip(empty).count() == 0
    assert dict(pieces.round_trip(empty.withColumn("doc_id", F.lit("x"))).dtypes)["doc_id"] == "string"
