import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boutwise.llm import align, bytebpe, queries, tokens

SPACE = "▁"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_values():
    """The character that stands for each byte in a byte-level vocabulary: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


def both_sides(libraries, text):
    """[(id, bytes)] of each side, by the libraries."""
    a, b = libraries
    if not text:
        return [], []
    of = byte_values()
    left = [(k, bytes(of[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace(SPACE, " ").encode()) for k in b.encode(text) for p in [b.id_to_piece(k)]]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == whole else ([], [])


def spans(side):
    at, out = 0, []
    for k, raw in side:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def expected(libraries, rows):
    """One result per (doc_id, text), by comparing spans."""
    found, counts = [], Counter()
    for doc_id, text in rows:
        left, right = map(spans, both_sides(libraries, text))
        links, j = [], 0
        for k, a, b in left:
            while j < len(right) and right[j][2] <= a:
                j += 1
            links += [(k, r) for r, c, d in right[j:j + b - a + 2] if c < b and d > a]
        counts.update(links)
        common = sorted({e for _, _, e in left} & {e for _, _, e in right})
        written, start = [], 0
        for end in common:
            written.append("|".join(",".join(str(k) for k, a, b in side if start <= a and b <= end) for side in (left, right)))
            start = end
        digest = hashlib.sha256(";".join(written).encode()).hexdigest() if left else ""
        found.append((doc_id, len(left), len(right), len(common), links, digest))
    highest = Counter()
    for (_, r), n in counts.items():
        highest[r] = max(highest[r], n)
    return sorted((str(d), a, b, g, len(x), sum(counts[y] == highest[y[1]] for y in x), sum(counts[y] for y in x), h) for d, a, b, g, x, h in found)


def as_rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def some(spark, docs, odd):
    more = spark.createDataFrame(
        [(9001, f"a {SPACE} b"), (9002, "x<s> <|endoftext|> <unk>"), (9003, " \n  two  blanks\t "), (9004, "\x00\U0001f600é")], "doc_id long, text string")
    return docs.filter("length(text) < 1500").limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more).repartition(3).cache()


@pytest.fixture(scope="module")
def wanted(some, libraries):
    return expected(libraries, [(r.doc_id, r.text) for r in some.collect()])


@pytest.mark.parametrize(("window", "most"), [(align.WINDOW, align.MOST_BROADCAST), (40, align.MOST_BROADCAST), (align.WINDOW, 200), (300, 0)])
def test_equals_brute_force(some, wanted, window, most):
    assert as_rows(align.align_tokens(some, window=window, most_broadcast=most)) == wanted


def test_blank_signs_have_no_tokens(some):
    rows = align.align_tokens(some).filter("doc_id = 9001").collect()
    assert [(r.n_a, r.n_b, r.n_links, r.count_sum, r.groups_sha256) for r in rows] == [(0, 0, 0, 0, "")]


def test_least_count(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 2, 3, 4, 9, 70])], "pair long, n long")
    for most in range(9):
        least = align.least_count(counts, most)
        assert counts.filter(F.col("n") >= least).count() <= most
    assert align.least_count(counts, 7) == 1 and align.least_count(counts, 5) == 2 and align.least_count(counts.limit(0), 5) == 1


def test_query(spark, tmp_path, some, wanted):
    some.withColumn("pair", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    assert as_rows(queries.QUERIES["op12_align_tokens"](spark, str(tmp_path))) == wanted


def test_empty_table(empty):
    assert align.align_tokens(empty).count() == 0


@pytest.mark.parametrize("text", ["a" + " " * 1_200_000 + "b", "\n" * 300_000, "漢" * 50_000, "word " * 300_000])
def test_very_long_texts(libraries, text):
    ids = bytebpe.load("byte_bpe_50k.json").ids(" " + text)
    assert ids.tolist() == libraries[0].encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
    both = align.tables(align.A, align.B)
    found = [x for part in align.windows(text, 1 << 18) for x in both.align([part])]
    assert sum(x[0] for x in found) == len(ids) and sum(x[1] for x in found) == len(libraries[1].encode(text))


@pytest.mark.parametrize("text", ["a" + " " * 1_200_000 + "b", "b" + "\n" * 1_200_000, "a" * 1_200_000, "x <|endoftext|>" + "\t" * 300_000 + "<|endoftext|> y"])
def test_token_counts_of_long_runs(spark, libraries, text):
    a = libraries[0]
    a.encode_special_tokens = False
    wanted = len(a.encode_batch_fast([text], add_special_tokens=False)[0].ids)
    a.encode_special_tokens = True
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}[1] == wanted
