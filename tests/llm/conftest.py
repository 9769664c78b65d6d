import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, rate double, row long, key string"


def odd_rows():
    """NULLs anywhere, empty and long texts, ties, repeated rows and columns whose names the operators use themselves."""
    passage = " ".join(f"w{k}" for k in range(60))
    long_line = "This Line is Long enough to count as a line"
    texts = [
        None, "", " \t\n ", "one", "One two three four", "a <|endoftext|> b", passage, f"intro {passage} outro",
        "Der " * 90, "ab cd " * 60, "x" * 5000, f"{long_line}\nshort\n  {long_line.upper()} \n", f"{long_line}\nother", f"\n{long_line}\n\n",
        "1234 5678 !!", "é è ü ß 漢字 \U0001f600 ok", "no break and space " * 30, passage, "naïve " * 2000 + passage]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None if t is None else len(t), "e", 1.5, 9, "k") for k, t in enumerate(texts)]
    rows += [rows[6], rows[11], (None, "null id", None, None, None, None, None, None, None), (None, passage, "en", "s1", 3, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def both(docs, odd):
    """The given documents, and the odd ones behind them."""
    return docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1_000_000), allowMissingColumns=True)
