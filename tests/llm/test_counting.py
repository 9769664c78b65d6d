"""Token counts, mixing, language, lines, substrings, fingerprints and benchmark hits against brute force."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutwise.llm import decontaminate, language, lines, mixing, recompress, simhash, substrings, tokens
from boutwise.llm.queries import QUERIES
FOLDER = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1: token counts


def reference_counts(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(e) for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (64, 16)])
def test_token_counts(both, chunk, overlap):
    given = pairs(both)
    want = sorted(((d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(given, reference_counts([t for _, t in given]), strict=True)), key=repr)
    assert rows(tokens.count_tokens(both, chunk=chunk, overlap=overlap), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_no_tokens_in_an_empty_table(empty):
    assert tokens.count_tokens(empty).count() == 0


def test_both_libraries_agree_on_every_code_point():
    encode, _ = tokens.encoder("byte_bpe_50k.tiktoken")
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}.{chr(c)}\n" for c in points[k:k + 64]) for k in range(0, len(points), 64)]
    assert [len(encode(t)) for t in texts] == reference_counts(texts)


# 2: mixing


def brute_targets(sizes, ceiling=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= ceiling * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("block", [4_096, 16])
def test_mix(both, block):
    mixed = mixing.mix_sources(both, block=block).collect()
    given = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in both.collect())
    assert Counter((r.doc_id, r.source, r.size) for r in mixed) == given
    sizes = Counter()
    for (_, source, size), n in given.items():
        sizes[source] += size * n
    want, taken = brute_targets(sizes), Counter()
    for r in mixed:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for _, source, size in given:
        largest[source] = max(largest[source], size)
    for source, goal in want.items():
        assert abs(taken[source] - goal) <= 2 * largest[source] + 1e-6
    again = mixing.mix_sources(both.repartition(7), block=block)
    assert rows(again, "doc_id", "source", "size", "taken") == sorted(((r.doc_id, r.source, r.size, r.taken) for r in mixed), key=repr)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.uniform(0, 1, 500), rng.integers(1, 4_000, 500).astype(float)
    size[:100] = 7  # ties
    goal = p.sum(), (p * size).sum()
    mixing.flight(p, size, rng.uniform(0, 1, 500))
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert np.allclose((p.sum(), (p * size).sum()), goal)


def test_mix_of_nothing(spark, empty):
    assert mixing.mix_sources(empty).count() == 0
    no_words = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert rows(mixing.mix_sources(no_words), "doc_id", "taken") == [(1, 0), (2, 0)]


def test_repeated_rows_are_dealt_to_many_blocks(spark):
    some = [(None, "a", 3)] * 9_000 + [(7, "a", 3)] * 500 + [(7, None, 0)] * 2 + [(8, "a", 1)]
    sized = spark.createDataFrame(some, "doc_id long, source string, size long")
    found = mixing.numbered(sized.repartition(5)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter(some)
    assert len({r.order for r in found if r.source == "a"}) == 9_501
    blocks = Counter(r.order % 64 for r in found)
    assert max(blocks.values()) < 2 * len(found) / 64
    docs = spark.createDataFrame([(1, "one two three", "a")] * 2_000 + [(2, "one", "b")] * 6_000, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, block=16)
    taken = {r.source: (r.taken, r.target) for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert mixed.count() == 8_000 and all(abs(got - goal) <= 6 for got, goal in taken.values())
    assert rows(mixed, "doc_id", "copies") == rows(mixing.mix_sources(docs.repartition(9), block=16), "doc_id", "copies")


# 5: language


def brute_languages(given, sample_docs, sample_chars):
    """Dictionaries and the sizes of every text under each, in plain loops."""
    import xxhash
    import zstandard as z

    def letters(text):
        return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())

    def spread(doc_id):
        h = xxhash.xxh64(doc_id.to_bytes(8, "little"), seed=42).intdigest() if doc_id is not None else 42
        return h - (1 << 64) if h >= 1 << 63 else h

    sample = {}
    for doc_id, text, lang in sorted({g for g in given if g[1] and g[2] is not None}, key=lambda g: (spread(g[0]), g[0] is not None, g[0] or 0)):
        sample.setdefault(lang, []).append((doc_id is None, doc_id or 0, text[:sample_chars]))
    lines = {lang: [(line, k) for k, (*_, text) in enumerate(sorted(x[:sample_docs])) for line in sorted({letters(t) for t in text.split("\n")} - {""})] for lang, x in sample.items()}
    held = Counter(line for found in lines.values() for line in {line for line, _ in found})
    coders = {}
    for lang in sorted(lines):
        raw = "\n".join(line for line, _ in lines[lang] if held[line] == 1).encode()[:100_000] or b" " * 8
        settings = z.ZstdCompressionParameters.from_level(3, source_size=100_000, dict_size=100_000, strategy=z.STRATEGY_BTLAZY2, min_match=4, search_log=6,
                                                          write_content_size=False, write_checksum=False, write_dict_id=False)
        content = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=settings)
        coders[lang] = z.ZstdCompressor(dict_data=content, compression_params=settings)

    def best(text):
        raw = letters(text or "").encode()
        sizes = {lang: sum(len(c.compress(raw[k:k + 1_024])) for k in range(0, len(raw), 1_024)) for lang, c in coders.items()}
        return min(sizes, key=lambda lang: (sizes[lang], lang)) if raw else "und"

    return best


def test_language_equals_brute_force(both):
    given = [(r.doc_id, r.text, r.lang) for r in both.collect()]
    # 8 rows a language, so that the choice of rows shows; rows without id share one hash and are all chosen or come last.
    best = brute_languages(given, 8, 500)
    found = language.predict_language(both, language.learn(both, 8, 500), keep=["doc_id", "text"]).collect()
    assert len(found) == len(given)
    wrong = [(r.doc_id, r.lang_pred, best(r.text)) for r in found if r.lang_pred != best(r.text)]
    assert not wrong


def test_numbers_are_no_letters(spark):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    kept = language.letters(" ".join(c for c in points if c.lower() == c)).split()
    assert kept == [c for c in points if c.lower() == c and c.isalpha()]
    texts = ["²½", "Ⅷ ① 4 _", "𐄇 🄀", "٣٤", "½ a", "漢", "ʰ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: r.lang_pred for r in language.predict_language(docs, {"en": b"the a"}, keep=["text"]).collect()}
    assert got == {"²½": "und", "Ⅷ ① 4 _": "und", "𐄇 🄀": "und", "٣٤": "und", "½ a": "en", "漢": "en", "ʰ": "en"}


def test_rows_without_id_teach(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(None, "solo senza numero", "it")] * 50 + [(None, "ancora una", "it"), (1, "only one", "en"), (1, "and another", "en"), (1, "only one", "en")],
        "doc_id long, text string, lang string")
    assert language.learn(docs, sample_docs=2) == {"en": b"and another\nonly one", "it": b"ancora una\nsolo senza numero"}
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.learn(docs)


def test_language_held_out(spark):
    found = {r.doc_id: r for r in QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL").collect()
    test = [r for r in docs if found[r.doc_id].held_out]
    assert len(test) > 100 and sum(found[r.doc_id].lang_pred == r.lang for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_of_odd_rows(odd, empty):
    learned = language.learn(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise(F.col("lang"))))
    assert set(learned) == {"aa", "en"}
    found = language.predict_language(odd, learned)
    assert found.count() == odd.count()
    for r in odd.select("doc_id", "text").join(found, "doc_id").collect():
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter) and (r.score == 0) == (not has_letter) and (has_letter or r.rejected)
    assert language.learn(empty) == {} and language.predict_language(empty, learned).count() == 0
    assert {r.lang_pred for r in language.predict_language(odd, {}).collect()} == {"und"}


# 6: lines


def brute_lines(given):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for d, t in given:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and d is not None:
                held[key(line)].add(d)
    out = []
    for d, t in given:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(held.get(key(x), ())) < 3 or d == max(held[key(x)])]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines(both, empty):
    found = lines.dedup_lines(both).withColumn("sha", F.sha2("kept", 256))
    assert rows(found, "doc_id", "n_lines", "n_dropped", "sha") == brute_lines(pairs(both))
    assert lines.dedup_lines(empty).count() == 0


# 7: substrings


def brute_substrings(given, window):
    seen = Counter()
    split = [(d, WORD.findall(t or "")) for d, t in given]
    for _, words in split:
        seen.update(tuple(words[k:k + window]) for k in range(len(words) - window + 1))
    out = []
    for d, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if seen[tuple(words[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [35, 12, 3])
def test_substrings(both, window):
    found = substrings.dedup_substrings(both, window)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(pairs(both), window)


def test_no_substrings_in_an_empty_table(empty):
    assert substrings.dedup_substrings(empty).count() == 0


def test_a_window_decides_its_symbols():
    """Symbols whose deciding words lie in a window stand in every equal window at the same place."""
    rng = np.random.default_rng(5)
    for trial in range(200):
        inner = rng.integers(0, 3 + trial % 5, 35).astype(np.uint64)
        sides = [rng.integers(0, 6, rng.integers(0, 20)).astype(np.uint64) for _ in range(4)]
        found = []
        for a, b in ((sides[0], sides[1]), (sides[2], sides[3])):
            names = recompress.mix(np.concatenate([a, inner, b]) + np.uint64(9))
            name, _, lo, hi = recompress.symbols(names, np.zeros(len(names), np.int64))
            own = (lo >= len(a)) & (hi <= len(a) + 35)
            found.append(sorted(zip(name[own].tolist(), (lo[own] - len(a)).tolist(), (hi[own] - len(a)).tolist(), strict=True)))
        assert found[0] == found[1]


# 8: SimHash


def brute_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(items, most=4):
    """Component of each (id, fp), named by its least id."""
    fps = sorted({f for _, f in items})
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    place = {f: k for k, f in enumerate(fps)}
    for d, f in items:
        k = find(place[f])
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return {f: least.get(find(place[f])) for f in fps}


def test_simhash(both, empty):
    found = simhash.near_copies(both)
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found.collect()]
    fps = [(d, brute_fingerprint(t)) for d, t in pairs(both)]
    named = brute_components(fps)
    assert sorted(got, key=repr) == sorted(((d, f, named[f]) for d, f in fps), key=repr)
    assert simhash.near_copies(empty).count() == 0


def test_links_in_groups_of_any_size(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for centre in list(fps)[:3]:
        for _ in range(150):
            fps.add(centre ^ sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(1, 9)))))
    items = [(k, f) for k, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f,) for _, f in items], "fp long")
    for block in (1_024, 20):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
        want = brute_components(items)
        least = {f: want[f] for _, f in items}
        got = {f: roots.get(f, f) for _, f in items}
        assert {f: items[least[f]][1] for _, f in items} == got


def test_one_of_each_group_stays(both):
    kept = simhash.keep_one(both)
    fps = [(d, brute_fingerprint(t)) for d, t in pairs(both)]
    named = brute_components(fps)
    assert kept.columns == both.columns
    assert rows(kept, "doc_id") == sorted(((d,) for d, f in fps if d is None or d == named[f]), key=repr)


# 9: decontamination

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(given, items, window=10):
    split = lambda t: BENCH_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k:k + window])].update([] if item is None else [str(item)])
    lengths, out = {len(w) for w in windows}, []
    for d, t in given:
        words, hit, found = split(t), set(), set()
        for size in lengths:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k:k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[w]
        out.append((d, len(words), len(hit), len(found), decontaminate.digest(list(found)), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_words", [2_000_000, 300])
def test_hits(spark, both, shard_words):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text")
    odd = [(1001, None), (1002, ""), (1003, "w7 w8 W9"), (1004, " ".join(f"w{k}" for k in range(20, 45))), (1004, "w7 w8 w9"), (None, "der der"), (None, None), (1005, "w9")]
    bench = bench.unionByName(spark.createDataFrame(odd, "item_id long, text string"))
    found = decontaminate.find_hits(both, bench, ["doc_id"], shard_words=shard_words).select(
        "doc_id", "n_words", decontaminate.hit_words(F.col("spans")).alias("n_hit"), F.size("items").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("sha"))
    got = [(*r, r.n_hit > 0) for r in found.collect()]
    assert sorted(map(tuple, got), key=repr) == brute_hits(pairs(both), [(r.item_id, r.text) for r in bench.collect()])


def test_long_items_are_cut_between_windows(spark):
    given = [(1, ",".join(f"w{k}" for k in range(100))), (2, "Only-few words"), (3, "., ,"), (4, None), (None, " ".join("abc" * 9))]
    pieces = decontaminate.item_pieces(spark.createDataFrame(given, "item_id long, text string"), 10, 20).collect()
    assert all(r.size == len(r.text.split()) <= 20 for r in pieces)

    def windows(rows):
        split = [(i, BENCH_WORD.findall((t or "").lower())) for i, t in rows]
        return {(i, tuple(w[k:k + 10])) for i, w in split if w for k in range(max(1, len(w) - 9))}

    assert windows([(r.item_id, r.text) for r in pieces]) == windows(given)


def test_hits_in_random_words(spark):
    rng = np.random.default_rng(11)
    items = [(k, " ".join(rng.choice(list("abc"), rng.integers(1, 16)))) for k in range(40)]
    texts = [(k, " ".join(rng.choice(list("abcd"), rng.integers(0, 60), p=[0.33, 0.33, 0.33, 0.01]))) for k in range(200)]
    for window in (10, 4):
        automaton = decontaminate.SuffixAutomaton([(k, t.encode()) for k, t in items], window)
        got = []
        for d, t in texts:
            n, spans, found = automaton.hits(t.encode())
            hit = {k for a, b in spans for k in range(a, b)}
            got.append((d, n, len(hit), len(found), decontaminate.digest(list(found)), bool(hit)))
        assert sorted(got, key=repr) == brute_hits(texts, items, window)


def test_decontaminate(spark, both, empty):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(10, 30)))], "item_id long, text string")
    kept = decontaminate.decontaminate(both, bench)
    assert kept.columns == both.columns
    want = [d for d, *_, bad in brute_hits(pairs(both), [(1, bench.first().text)]) if not bad]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(both, bench, most_coverage=0.9).collect()}
    assert cut[1_000_007] == "intro " + " ".join(f"w{k}" for k in [*range(10), *range(30, 60)]) + " outro"
    assert decontaminate.decontaminate(empty, bench).count() == 0 and decontaminate.decontaminate(both, bench.limit(0)).count() == both.count()
