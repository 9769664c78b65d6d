"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds every document's signature: a Bloom filter over its terms, and over "term at least 2, 4, 8, ... times", whose
width grows with what goes in. Documents of one width form blocks, stored by slice: bit p of all documents is one bitmap over
the block's rows. The bitmaps of a query term's bits, and-ed, show where it may occur; they err only towards presence. So the
sums of weights over the slices of each frequency level, each times what that level can add at the document's length, are
an upper bound of its score, for all documents of a block at once.

A search takes the documents of the highest bounds, scores them exactly, and so gets for every query a score that ten documents
reach. Every document whose bound reaches it is scored exactly from its text; the others are proven to be out.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutwise.llm.common import encoded, slices, stored
from boutwise.llm.decontaminate import words_of

#: The contract's terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEVELS = 8  # a term at least 1, 2, 4, ..., 128 times
BITS = 8  # of a signature for each entry, at least
BLOCK_ROWS, BLOCK_BITS = 1024, 1 << 24
FIRST = 32  # documents scored exactly for each query to find its threshold
QUERY_TERMS = 100_000  # of the queries of one pass
MOST_BROADCAST = 1_000_000  # survivors
_SHARED: dict[str, object] = {}


def places(hashes: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each term at a level, in a signature of `width` (a power of two)."""
    mixed = (hashes + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64(width - 1)
    return ((mixed >> np.uint64(7)) & mask).astype(np.int64), ((mixed >> np.uint64(36)) & mask).astype(np.int64)


def hashed(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))


def counted(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; the distinct terms; and (text, term, times) of all texts, by text."""
    words = list(map(words_of, texts))
    n = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
    terms = coded.dictionary.to_pylist()
    most = max(len(terms), 1)
    keys, times = np.unique(np.repeat(np.arange(len(n)), n) * most + coded.indices.to_numpy(), return_counts=True)
    return n, terms, keys // most, keys % most, times


def signatures(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, list[tuple[np.ndarray, int, bytes]]]:
    """Terms of each text, the distinct terms, in how many texts each is, and blocks: (texts, width, slices)."""
    n, terms, text, term, times = counted(texts)
    levels = np.minimum(np.log2(np.maximum(times, 1)).astype(np.int64), LEVELS - 1) + 1
    entries = np.bincount(text, levels, minlength=len(n)).astype(np.int64)
    widths = 1 << np.ceil(np.log2(np.maximum(BITS * entries, 64))).astype(np.int64)
    hashes, blocks = hashed(terms), []
    starts = np.searchsorted(text, np.arange(len(n) + 1))
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        step = max(8, min(BLOCK_ROWS, BLOCK_BITS // width))
        for at in range(0, len(rows), step):
            block = rows[at:at + step]
            held = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in block])
            row = np.repeat(np.arange(len(block)), starts[block + 1] - starts[block])
            bits = np.zeros((width, len(block)), bool)
            for level in range(LEVELS):
                here = levels[held] > level
                if not here.any():
                    break
                for place in places(hashes[term[held[here]]], level, width):
                    bits[place, row[here]] = True
            blocks.append((block, width, np.packbits(bits, axis=1).tobytes()))
    return n, terms, np.bincount(term, minlength=len(terms)), blocks


INDEX = "keys array<long>, n array<long>, width int, slices binary, n_docs long, n_terms long, terms array<binary>, dfs array<long>"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    kinds = (longs, longs, pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), longs)
    names = ["keys", "n", "width", "slices", "n_docs", "n_terms", "terms", "dfs"]
    for batch in slices(batches, "text"):
        n, terms, dfs, blocks = signatures(encoded(batch.column("text")))
        keys = batch.column("key").to_numpy()
        for rows, width, bits in blocks:  # one at a time, as they may be large
            row = (keys[rows], n[rows], width, bits, int((n[rows] > 0).sum()), int(n[rows].sum()), None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*[None] * 6, terms, dfs), kinds, strict=True)], names=names)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents by a key of their id and text; where two share a key, both are scored."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of `docs` (doc_id, text, ...): a row per block of signatures, and a row of document counts by term per slice."""
    return stored(keyed(docs).select("key", "text").mapInArrow(_index, INDEX))


@dataclass
class Queries:
    """The queries of one pass, with the corpus figures that scores need."""

    ids: list[int]  # numbers of the queries
    of: np.ndarray  # the query of each entry, ascending
    term: np.ndarray  # its place in `terms`
    terms: list[bytes]
    weight: np.ndarray  # by term
    n_docs: int
    n_terms: int

    def lengths(self, n):
        """m of documents with n terms."""
        return 10 + (90 * n * self.n_docs) // max(self.n_terms, 1)

    def bounds(self, n: np.ndarray, width: int, raw: bytes) -> np.ndarray:
        """Upper bounds of the scores, query by document, of one block."""
        bits = np.frombuffer(raw, np.uint8).reshape(width, -1)
        m, out, before, here, hashes = self.lengths(n), np.zeros((len(self.ids), len(n)), np.int64), np.int64(0), None, self.hashes
        starts = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]])
        term, of = self.term, self.of
        for level in range(LEVELS):
            first, second = places(hashes, level, width)
            found = bits[first] & bits[second]
            here = found if here is None else here & found
            some = here.any(axis=1)[term]
            if not some.any():
                break
            if not some.all():
                term, of = term[some], of[some]
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            shown = np.unpackbits(here, axis=1, count=len(n)).astype(bool)
            sums = np.add.reduceat(np.where(shown[term], self.weight[term][:, None], 0), starts, axis=0)
            most = np.minimum(n, (2 << level) - 1) if level < LEVELS - 1 else n
            adds = (10**9 * most) // (1000 * most + 8 * m)
            out[of[starts]] += sums * (adds - before)
            before = adds
        return out

    @property
    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = hashed(self.terms)
        return self._hashes

    def scores(self, raw: bytes, wanted: list[int]) -> list[int]:
        """Exact scores of one text for the queries at the places `wanted`."""
        words = words_of(raw)
        counts, m = Counter(words), self.lengths(len(words))
        out = []
        for k in wanted:
            a, b = np.searchsorted(self.of, [k, k + 1])
            score = 0
            for t in self.term[a:b].tolist():
                tf = counts.get(self.terms[t], 0)
                if tf:
                    score += int(self.weight[t]) * (10**9 * tf // (1000 * tf + 8 * m))
            out.append(score)
        return out


def _shared(shared, key: str):
    if key not in _SHARED:
        if len(_SHARED) > 2:
            _SHARED.clear()
        _SHARED[key] = shared.value
    return _SHARED[key]


def _highest(shared, key: str, first: int):
    """(query, key, bound) of a task's `first` highest bounds of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _shared(shared, key)
        best, best_keys = np.zeros((len(queries.ids), 0), np.int64), np.zeros((len(queries.ids), 0), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                keys, n = (np.asarray(batch.column(c)[row].values, np.int64) for c in ("keys", "n"))
                bounds = queries.bounds(n, batch.column("width")[row].as_py(), batch.column("slices")[row].as_py())
                best = np.concatenate([best, bounds], axis=1)
                best_keys = np.concatenate([best_keys, np.broadcast_to(keys, bounds.shape)], axis=1)
                if best.shape[1] > first:
                    top = np.argpartition(-best, first - 1, axis=1)[:, :first]
                    best, best_keys = np.take_along_axis(best, top, 1), np.take_along_axis(best_keys, top, 1)
        at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(best_keys[at]), pa.array(best[at])], names=["query", "key", "bound"])

    return run


def _reaching(shared, key: str, thresholds: np.ndarray):
    """(query, key) of every document whose bound reaches the query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _shared(shared, key)
        for batch in batches:
            for row in range(batch.num_rows):
                keys, n = (np.asarray(batch.column(c)[row].values, np.int64) for c in ("keys", "n"))
                bounds = queries.bounds(n, batch.column("width")[row].as_py(), batch.column("slices")[row].as_py())
                at = np.nonzero(bounds >= thresholds[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(keys[at[1]])], names=["query", "key"])

    return run


def _exact(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _shared(shared, key)
        for batch in slices(batches, "text"):
            wanted = batch.column("queries").to_pylist()
            scores = [queries.scores(raw, w) for raw, w in zip(encoded(batch.column("text")), wanted, strict=True)]
            row = np.repeat(np.arange(batch.num_rows), list(map(len, wanted)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(list(chain.from_iterable(wanted)), pa.int32()), pa.array(list(chain.from_iterable(scores)), pa.int64())],
                names=["doc_id", "query", "score"])

    return run


def _scored(docs: DataFrame, pairs: DataFrame, shared, key: str, most_broadcast: int) -> DataFrame:
    """doc_id, query and exact score of the documents behind stored (query, key) pairs."""
    few = pairs.count() <= most_broadcast
    wanted = pairs.groupBy("key").agg(F.collect_set("query").alias("queries"))
    found = keyed(docs).join(F.broadcast(wanted) if few else wanted, "key").select("doc_id", "text", "queries")
    return found.mapInArrow(_exact(shared, key), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, query int, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_pass(docs: DataFrame, index: DataFrame, totals, items: list, k: int, first: int, most_broadcast: int) -> DataFrame | None:
    """query (a place in `items`), rank, doc_id and score; `items` are of bounded size."""
    spark = docs.sparkSession
    held = [sorted(set(words_of(text.encode()))) for _, text in items]
    distinct = spark.createDataFrame([(t,) for t in sorted({t for ts in held for t in ts})], "term binary")
    found = index.filter("width IS NULL").select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(
        F.col("x.terms").alias("term"), F.col("x.dfs").alias("df")).join(F.broadcast(distinct), "term").groupBy("term").agg(F.sum("df").alias("df"))
    df = {bytes(r.term): r.df for r in found.collect()}  # no more rows than query terms
    terms = sorted(df)
    number = {t: at for at, t in enumerate(terms)}
    entries = [(q, number[t]) for q, ts in enumerate(held) for t in ts if t in number]
    if not entries:
        return None
    of, term = np.array(entries, np.int64).T
    weight = np.array([math.floor(1000 * math.log((2 * totals.n_docs + 2) / (2 * df[t] + 1))) for t in terms], np.int64)
    queries = Queries(list(range(len(items))), of, term, terms, weight, totals.n_docs, totals.n_terms)
    shared, key, blocks = spark.sparkContext.broadcast(queries), uuid.uuid4().hex, index.filter("width IS NOT NULL").select("keys", "n", "width", "slices")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "key")
    highest = blocks.mapInArrow(_highest(shared, key, max(first, k)), "query int, key long, bound long")
    tried = stored(highest.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max(first, k)).select("query", "key"))
    reached = _best(_scored(docs, tried, shared, key, most_broadcast), k).filter(F.col("rank") == k).select("query", "score").collect()  # one row a query
    thresholds = np.ones(len(items), np.int64)
    for row in reached:
        thresholds[row["query"]] = row["score"]
    survivors = stored(blocks.mapInArrow(_reaching(shared, key, thresholds), "query int, key long"))
    return _best(_scored(docs, survivors, shared, key, most_broadcast), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, index: DataFrame | None = None, first: int = FIRST, query_terms: int = QUERY_TERMS,
           most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """item_id, rank, doc_id and score of the `k` best documents of each item, equal scores by ascending doc_id, NULL ids last.

    `docs` is (doc_id, text, ...), `items` (item_id, text, ...); `index` is that of `docs` if it is built already. NULL and
    empty texts hold no term and score for nothing; an item without terms, or an empty table, gives no rows. Repeated rows of
    documents are ranked each; repeated rows of an item once. Other columns are left out. Items of more than `query_terms`
    terms are searched in several passes over the index.
    """
    docs = docs.select("doc_id", "text")
    index = build_index(docs) if index is None else index
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")).first()
    items = items.select("item_id", "text").filter("text IS NOT NULL").dropDuplicates()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    passes = 1 if total <= query_terms else -(-2 * total // query_terms)
    kind, spark = items.schema["item_id"].dataType.simpleString(), docs.sparkSession
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for at in range(passes):
        part = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == at)
        block = [(r.item_id, r.text) for r in part.collect()]  # bounded by query_terms
        found = _search_pass(docs, index, totals, block, k, first, most_broadcast) if block and totals.n_docs else None
        if found is not None:
            names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"query int, item_id {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out
