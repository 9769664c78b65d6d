import random

import pytest
from pyspark.sql import functions as F

from boutwise.operators import resolve


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(rnd, text, times):
    for _ in range(times):
        at, letter = rnd.randrange(len(text) + 1), rnd.choice("abc ")
        text = text[:at] + rnd.choice(["", letter, letter + text[at:at + 1]]) + text[at + 1:]
    return text


@pytest.mark.parametrize("share", [0.85, 0.85 / 0.95, 1.0])
def test_similar_texts_are_all_pairs(spark, share):
    rnd = random.Random(7)
    known = {"".join(rnd.choice("abc ") for _ in range(rnd.choice([0, 1, 2, 5, 9, 17, 18, 28, 29, 34]))) for _ in range(60)}
    mine = {changed(rnd, t, rnd.randrange(6)) for t in known for _ in range(2)} | {"", "a"}
    got = resolve.similar_texts(spark.createDataFrame([(t,) for t in sorted(mine)], "t string"), spark.createDataFrame([(t,) for t in sorted(known)], "u string"), share)
    want = {(a, b) for a in mine for b in known if edits(a, b) <= max(len(a), len(b)) * (1 - share) + 1e-9}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10


def test_few_names_share_the_keys_of_a_name():
    """Two parts are compared and not one, so that names of a common beginning do not all meet."""
    for own, known, i, j, a, m, b, n, c, d in resolve.part_pairs(17, 17, 0.85):
        assert m + n >= 6 and c + m <= d and d + n <= own == known == 17 and i < j
    assert 4 <= len(resolve.part_pairs(17, 17, 0.85)) <= 4 * 7  # four pairs of parts in seven places, fewer at the ends
    assert resolve.part_pairs(13, 17, 0.85) == []


def test_names_of_one_surname_and_beginning_meet_few(spark):
    """A thousand names of one length that all hold the same words: the join on two parts meets those that are near."""
    names = spark.range(1000).select(F.concat(F.lit("maria "), F.lpad(F.conv(F.xxhash64("id"), 10, 16), 10, "0")).alias("t"))
    plan = resolve.similar_texts(names, names.toDF("u"), 0.85)
    assert plan.distinct().count() == 1000


def test_folds_store_a_row_once(spark, monkeypatch):
    from boutwise.operators import learning

    stored, write = [], learning.materialize
    monkeypatch.setattr(learning, "materialize", lambda df, *by: stored.append(df.count()) or write(df, *by))
    df = spark.range(200).selectExpr("id AS d", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 3 = 0 AS INT) AS y")
    out = learning.temporal_cv(df, ["x"], "y", ["d"], {"logreg": {"kind": "logreg"}}, folds=3, min_train=60, min_test=20)
    assert stored[0] <= 200  # every fold brought its own rows, 420 in all
    assert {(r["fold"], r["n"]) for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {(1, 28), (2, 28), (3, 28)}
