"""Language identification by compression: the language whose raw-content dictionary makes a text smallest.

Texts are lower-cased and reduced to letters and single spaces. Each language's dictionary is its share of a bounded
sample of labelled rows; a line that the samples of several languages hold (licences, menus) is left out. A text is cut
into pieces so that a long one cannot become its own dictionary; every piece is encoded once per language and the sizes
add up. A narrow margin between the two smallest sizes is a rejection.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutwise.llm.common import slices

SAMPLE_DOCS = 64  # labelled documents per language that a dictionary is made from
SAMPLE_CHARS = 4_000  # of each of them
DICTIONARY_BYTES = 100_000
PIECE_BYTES = 1_024
LEAST_MARGIN = 0.001
MOST_LANGUAGES = 1_000  # 100 MB of dictionaries; more languages than that are refused
UNKNOWN = "und"
# What is a word character but no letter: decimal digits, and numbers such as fractions, superscripts and Roman numerals.
# Those past U+FFFF are kept apart, as a character class that holds them is tried range by range.
_NUMBERS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
_OTHER = re.compile(rf"[\W\d_{''.join(c for c in _NUMBERS if c <= '\uffff')}]+")
_FAR = re.compile("[\U00010000-\U0010ffff]")
_FAR_NUMBERS = re.compile(f"[{''.join(c for c in _NUMBERS if c > '\uffff')}]+")


def letters(text: str) -> str:
    """Lower case, every run of other characters one space."""
    text = text.lower()
    if not text.isascii() and _FAR.search(text):
        text = _FAR_NUMBERS.sub(" ", text)
    return _OTHER.sub(" ", text).strip()


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary of each language in `labelled` (doc_id, text, lang); rows without text or lang teach nothing, rows without id do.

    Row keys are chosen first and the texts of the chosen rows read after, so that no text is sorted. Repeated rows count
    once; of one doc_id's different texts each takes a place. More than `MOST_LANGUAGES` languages are an error.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "doc_id", "text")
    if usable.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError("more languages than dictionaries may be sent to every task")
    key = F.xxhash64("lang", "doc_id", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    places = usable.select("lang", "doc_id", key.alias("key")).distinct().withColumn("place", F.row_number().over(order))
    chosen = places.filter(F.col("place") <= sample_docs).select("key").collect()  # at most sample_docs rows a language
    rows = usable.filter(key.isin([r.key for r in chosen])).select(
        "lang", "doc_id", F.substring("text", 1, sample_chars).alias("text")) if chosen else usable.limit(0)
    texts: dict[str, list[list[str]]] = {}
    for row in sorted(rows.dropDuplicates().collect(), key=lambda r: (r.lang, r.doc_id is None, r.text if r.doc_id is None else r.doc_id, r.text)):
        texts.setdefault(row.lang, []).append(sorted(set(map(letters, row.text.split("\n"))) - {""}))
    shared = Counter(line for lang in texts for line in {x for lines in texts[lang] for x in lines})
    return {lang: "\n".join(x for lines in texts[lang] for x in lines if shared[x] == 1).encode()[:DICTIONARY_BYTES] for lang in sorted(texts)}


class Classifier:
    """Made once per worker out of the learned dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.languages, self.encoders = sorted(dictionaries), []
        settings = z.ZstdCompressionParameters.from_level(
            3, source_size=DICTIONARY_BYTES, dict_size=DICTIONARY_BYTES, strategy=z.STRATEGY_BTLAZY2, min_match=4, search_log=6,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        for lang in self.languages:
            content = z.ZstdCompressionDict(dictionaries[lang] or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.encoders.append(z.ZstdCompressor(dict_data=content, compression_params=settings).compress)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): score from 0 to 1 rises with the bytes saved, margin is their share."""
        raw = letters(text or "").encode()
        if not raw or not self.encoders:
            return UNKNOWN, 0.0, 0.0
        pieces = [raw[k:k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]
        sizes = [sum(map(len, map(encode, pieces))) for encode in self.encoders]
        best = int(np.argmin(sizes))
        others = sizes[:best] + sizes[best + 1:]
        saved = (min(others) - sizes[best]) if others else sizes[best]
        return self.languages[best], 1 - 0.5 ** (1 + min(saved, 400) / 4), saved / (saved + sizes[best])


GUESS = "lang_pred string, score double, margin double"


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (default: doc_id) plus lang_pred, score, margin and rejected for every row.

    NULL texts and texts without a letter are `und`, score 0, rejected. rejected also means a margin under
    `least_margin`, ties included; lang_pred then still names the best (of a tie the first by name).
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most DICTIONARY_BYTES x MOST_LANGUAGES
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    made: list[Classifier] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = (made or made.append(Classifier(shared.value)) or made)[0]
        for batch in slices(batches, "text"):
            found = [classify(t) for t in batch.column("text").to_pylist()]
            guess = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *guess], names=[*keep, "lang_pred", "score", "margin"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{schema}, {GUESS}").withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < least_margin))


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Documents kept from learning; a NULL id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
