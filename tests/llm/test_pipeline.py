"""The whole pipeline against a brute-force version of its stages."""

from collections import Counter, defaultdict

from test_counting import WORD, brute_components, brute_fingerprint, brute_hits, brute_targets

import corpus_pipeline
from boutwise.llm import language

FOLDER = "/root/testdata/sf0.001"


def kept_lines(given):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for d, t in given:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    out = {}
    for d, t in given:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(held.get(key(x), ())) < 3 or d == max(held[key(x)])]
        if len(kept) == len(parts):
            out[d] = t
        elif "\n".join(kept):
            out[d] = "\n".join(kept)
    return out


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    classify = language.Classifier(language.learn(docs.filter(~language.held_out(docs.doc_id))))
    found = {d: classify(r.text) for d, r in rows.items()}
    texts = {d: r.text for d, r in rows.items() if found[d][0] != "und" and found[d][2] >= language.LEAST_MARGIN}
    texts = kept_lines(list(texts.items()))
    fps = [(d, brute_fingerprint(t)) for d, t in texts.items()]
    named = brute_components(fps)
    texts = {d: texts[d] for d, f in fps if named[f] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {d: texts[d] for d, *_, bad in brute_hits(list(texts.items()), items) if not bad}
    assert 0.5 * len(rows) < len(texts) < len(rows)

    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, out, FOLDER))
    got = {r.doc_id: r for r in out.collect()}
    assert {d: r.text for d, r in got.items()} == texts and out.columns == docs.columns
    assert all(r.lang == found[d][0] and r.source == rows[d].source and r.n_chars == len(r.text) for d, r in got.items())

    mixed = corpus_pipeline.run(spark, FOLDER).collect()
    size = {d: len(WORD.findall(t)) for d, t in texts.items()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for d in texts:
        sizes[rows[d].source] += size[d]
        largest[rows[d].source] = max(largest[rows[d].source], size[d])
    for r in mixed:
        assert r.text == texts[r.doc_id] and 1 <= r.copies <= 3
        taken[r.source] += r.copies * size[r.doc_id]
    assert len({r.doc_id for r in mixed}) == len(mixed)
    for source, goal in brute_targets(sizes).items():
        assert abs(taken[source] - goal) <= 2 * largest[source] + 1e-6
