import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.llm import queries, search

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df, out = Counter(t for _, c in counts for t in c), []
    for item, text in items:
        scores = []
        for doc_id, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    given = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    more = [(900, "One two three FOUR"), (901, "naïve w1 w2 w3"), (902, "漢字 ok"), (903, None), (904, ""), (905, "zzzzunheardof"), (None, "this line is long"), (900, "One two three FOUR")]
    return given.unionByName(spark.createDataFrame(more, given.schema)).cache()


@pytest.fixture(scope="module")
def wanted(both, items):
    distinct = dict.fromkeys((r.item_id, r.text) for r in items.collect())
    return brute([(r.doc_id, r.text) for r in both.collect()], list(distinct))


@pytest.mark.parametrize("options", [{}, {"first": 1}, {"query_terms": 300}, {"most_broadcast": 0}])
def test_equals_brute_force(both, items, wanted, options):
    assert rows(search.search(both, items, **options)) == wanted


def test_bounds_are_never_below_scores_and_exclude_most(docs, items):
    texts = [r.text.encode() for r in docs.select("text").collect()]
    n, terms, dfs, blocks = search.signatures(texts)
    df = dict(zip(terms, dfs.tolist(), strict=True))
    held = [sorted({t.encode() for t in terms_of(r.text)} & set(terms)) for r in items.collect()]
    used = sorted({t for h in held for t in h})
    of = np.array([k for k, h in enumerate(held) for _ in h])
    term = np.array([used.index(t) for h in held for t in h])
    weight = np.array([math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[t] + 1))) for t in used])
    found = search.Queries(list(range(len(held))), of, term, used, weight, len(texts), int(n.sum()))
    out = total = 0
    for members, width, raw in blocks:
        bounds = found.bounds(n[members], width, raw)
        exact = np.array([found.scores(texts[r], list(range(len(held)))) for r in members]).T
        assert (bounds >= exact).all()
        tenth = np.sort(exact, axis=1)[:, -10:].min(axis=1)
        if len(members) > 20:
            out += (bounds < tenth[:, None]).sum()
            total += bounds.size
    assert out > 0.5 * total


def test_an_index_is_built_once(both, items, wanted):
    assert rows(search.search(both, items, index=search.build_index(both))) == wanted


def test_query_equals_its_twin(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    twin = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLES['op11_lexical_search']})").fetchall(), key=str)
    assert rows(queries.QUERIES["op11_lexical_search"](spark, FOLDER)) == twin


def test_empty_tables(both, items, empty):
    assert search.search(empty, items).count() == 0
    assert search.search(both, items.limit(0)).count() == 0
    assert search.search(both, items.filter("item_id IN (903, 904, 905)")).count() == 0


def test_clashing_columns(both, items, wanted):
    odd = both.withColumn("key", F.lit(1)).withColumn("query", F.lit(1)).withColumn("score", F.lit("s"))
    assert rows(search.search(odd, items.withColumn("rank", F.lit(3)).withColumn("doc_id", F.lit(1)))) == wanted
