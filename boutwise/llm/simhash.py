"""SimHash near-dedup with pivot distance tables.

For every distinct fingerprint the Hamming distances to reference fingerprints are its coordinates. By the triangle
inequality two fingerprints within `most_bits` differ by no more than that in any coordinate, so a pair with a larger
difference is discarded unseen by the exact test.

Two tables are used. Band references (the unit fingerprints and zero) place the search: relative to zero the coordinates
of a band's references spell that band, a differing bit moves one band only, and with four differing bits at least three of
seven bands have all their coordinates unchanged. So every pair within reach meets in a group with equal coordinates
in some three bands: 35 groupings with keys of 27 bits or more, however large the table. Inside a group the second
table, of random references, discards pairs by their maximum coordinate difference; survivors are verified exactly.

Groups of two, nearly all, stay in the JVM. Larger ones are cut into blocks of bounded size, each pair of blocks is one
unit of work, and a unit returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutwise.llm.common import encoded, slices, stored
from boutwise.llm.links import components

SHINGLE, MOST_BITS, SEED = 4, 4, 42
BANDS, EQUAL = 7, 3
BLOCK = 1_024
REFERENCES = 24


def fingerprint_of(raw: bytes, shingle: int = SHINGLE) -> int:
    """64 majority bits over XXH64 of all shingles, repeats included; zero for a text without words."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[k:k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row of `docs`; NULL texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint_of(raw, shingle) for raw in encoded(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def distances(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ references[None, :])


def random_references(n: int = REFERENCES) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, size=n, dtype=np.uint64)


UNITS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])


def band_keys(fps: np.ndarray, bands: int = BANDS, equal: int = EQUAL) -> np.ndarray:
    """Keys of each fingerprint, one per choice of `equal` bands: which bands, and the coordinates there."""
    table = distances(fps, UNITS).astype(np.int8)
    coordinates = table[:, :1] - table[:, 1:]  # to zero less to the unit: 1 or -1
    bits = (coordinates > 0).astype(np.uint64)
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    spelled = [(bits[:, a:b] << np.arange(b - a, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for a, b in zip(edges, edges[1:], strict=False)]
    widths = [np.uint64(b - a) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(range(bands), equal)):
        key = np.full(len(fps), number, dtype=np.uint64)
        for band in chosen:
            key = (key << widths[band]) | spelled[band]
        keys.append(key)
    return np.stack(keys, axis=1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 8_192):
            fps = batch.column("fp").slice(k, 8_192).to_numpy(zero_copy_only=False)
            keys = band_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(fps, keys.shape[1]))], names=["key", "fp"])


def close_pairs(left: np.ndarray, right: np.ndarray, references: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within `most` bits: first the references one by one on the pairs still open, then the exact distance."""
    a, b = distances(left, references).astype(np.int8), distances(right, references).astype(np.int8)
    i, j = np.nonzero(np.abs(a[:, None, 0] - b[None, :, 0]) <= most)
    for k in range(1, len(references)):
        open_ = np.abs(a[i, k] - b[j, k]) <= most
        if k > 4 and open_.mean() > 0.9:
            break  # what is left is close; the exact test decides
        i, j = i[open_], j[open_]
    exact = np.bitwise_count(left[i] ^ right[j]) <= most
    return i[exact], j[exact]


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index connected with each of `size` items."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return root


def _linked(most: int):
    references = random_references()

    def unit(fps: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(halves == 0)
        right = np.flatnonzero(halves == 1)
        if not len(right):  # a block with itself
            i, j = close_pairs(fps, fps, references, most)
        else:
            i, j = close_pairs(fps[left], fps[right], references, most)
            i, j = left[i], right[j]
        root = forest(len(fps), i, j)
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return fps[root[moved]].view(np.int64), fps[moved].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y", "half", "fp")]
            if carried is not None:
                new = [np.concatenate(pair) for pair in zip(carried, new, strict=True)]
            change = np.flatnonzero((np.diff(new[0]) != 0) | (np.diff(new[1]) != 0) | (np.diff(new[2]) != 0)) + 1
            last = int(change[-1]) if len(change) else 0
            yield from _units(unit, [c[:last] for c in new], change)
            carried = [c[last:] for c in new]
        if carried is not None and len(carried[0]):
            yield from _units(unit, carried, np.array([len(carried[0])]))

    def _units(unit, columns, change):
        starts = np.r_[0, change[:-1]] if len(change) else []
        found = [unit(columns[4][a:b].view(np.uint64), columns[3][a:b]) for a, b in zip(starts, change, strict=True)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    return run


def links(fps: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect what pairs of distinct fingerprints (fp) within `most_bits` connect."""
    if most_bits > BANDS - EQUAL:
        raise ValueError("more differing bits than the bands allow")
    keyed = fps.mapInArrow(_keyed, "key long, fp long")
    groups = stored(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    pairs = groups.filter("n = 2").select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)
    blocks = F.ceil(F.col("n") / block)
    members = keyed.join(groups.filter("n > 2").select("key", "n"), "key").select(
        "key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("own"))
    # Every pair of blocks (x <= y) gets the rows of both: an exact self-join in units of bounded size.
    units = members.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("half"), "fp")
    dealt = units.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return pairs.unionByName(dealt.mapInArrow(_linked(most_bits), "a long, b long"))


def near_copies(docs: DataFrame, most_bits: int = MOST_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) for every row of `docs` (doc_id, text, ...).

    Texts without words share fingerprint zero and are linked like any other. Equal fingerprints are one class. Rows
    without doc_id take part, and never name a component unless all its rows lack one.
    """
    marked = stored(fingerprints(docs, shingle))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(classes.select("fp"), most_bits))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """`docs` with one document of each group of near copies: the one with the smallest doc_id, its rows all of them."""
    groups = near_copies(docs, most_bits)
    gone = groups.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("component_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
