"""Main text, FLAC and tool calls against brute force, exact round trips and held-out forms; the pipeline stage by stage."""

import hashlib
import html as entities
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boutwise.llm import flac, html, toolcalls
from boutwise.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


# 3: main text


def article(source):
    """The text of the article element of the given pages, whose blocks are h1 and p."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html.train(pages, 60)


def test_main_text(pages, model):
    want = {r.page_id: article(r.html) for r in pages.collect()}
    found = {r.page_id: r for r in html.extract_text(pages, model).collect()}
    assert {k: r.text for k, r in found.items()} == want
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_main_text_of_rewritten_pages(pages, model):
    """Pages in forms the model was trained on, but none of these pages: the texts put in must go, the article must stay."""
    rows, good, all_ = pages.orderBy("page_id").limit(40).collect(), 0, 0
    for k, r in enumerate(rows):
        for form in range(1, 6):
            nodes = html.parse(html.rewritten(r.html, rows[k - 1].html, form))
            odds = html.log_odds(model, np.array(html.features(nodes)))
            got = "\n".join(html.block_texts(nodes, html.decode(nodes, odds)))
            good, all_ = good + (got == article(r.html)), all_ + 1
    assert good >= 0.95 * all_


def test_no_block_is_kept_under_a_dropped_one():
    rng = np.random.default_rng(2)
    nodes = html.parse("<body><div>a<p>b<p>c</div><div><ul><li>d<li>e</ul>f</div>")
    for _ in range(200):
        keep = dict(zip(map(id, nodes), html.decode(nodes, rng.normal(size=len(nodes))), strict=True))
        assert all(not keep[id(n)] or n.parent is None or keep[id(n.parent)] for n in nodes)


def test_odd_pages(spark, pages, model):
    sources = [None, "", "plain text &amp; more", "<p>one<p>two &lt;b&gt; <b>three</b>\n four<!-- gone --><script>if (a < b) {'</p>'}</script></p>",
               "<article><p>" + "word, and. " * 30_000 + "</p></article>", "<" * 50 + "<p", "<article><p>a &nbsp; b</p></article></div></p>"]
    df = spark.createDataFrame([(k, None if k % 2 else "u", s, "x", 1.0) for k, s in enumerate(sources)] + [(1, None, "", "x", 1.0)],
                               "page_id long, url string, html string, features string, label double")
    found = html.extract_text(df, model).collect()
    assert len(found) == len(sources) + 1
    by = {r.page_id: r.text for r in found}
    assert by[0] == by[1] == "" and len(by[4]) == len("word, and. " * 30_000) - 1
    assert html.extract_text(df.limit(0)).count() == 0 and {r.text for r in html.extract_text(df.filter("page_id < 2")).collect()} == {""}
    nodes = html.parse(sources[3])
    assert html.block_texts(nodes, [True] * len(nodes)) == ["one", "two <b> three four"]


def test_siblings_follow_one_rule_at_every_family_size():
    """Place, number, mean size and 'is the first largest' of siblings, of the whole family whatever its size."""
    at = html.N_FEATURES - 11
    for n in (1, 5, 33, 34, 63, 64, 65, 200):
        sizes = [10 + (7 * k) % 50 for k in range(n)]
        sizes[n * 3 // 4] = 99
        nodes = html.parse("<div>" + "".join(f"<p>{'x' * size}</p>" for size in sizes) + "</div>")
        rows = [row[at:at + 5] for node, row in zip(nodes, html.features(nodes), strict=True) if node.tag == "p"]
        assert [r[:3] for r in rows] == [[k, n, k / n] for k in range(n)]
        assert all(abs(r[3] - np.log1p(sum(sizes) / n)) < 1e-9 for r in rows)
        assert [r[4] for r in rows] == [float(k == n * 3 // 4) for k in range(n)]


# 4: FLAC


def some_payloads():
    rng = np.random.default_rng(1)
    wave = (128 + 100 * np.sin(np.arange(9_000) / 30)).astype(np.uint8)
    spikes = np.tile(np.r_[np.zeros(575), 255].astype(np.uint8), 200)
    raws = [b"", b"a" * 5_000, rng.integers(0, 256, 1_728, dtype=np.uint8).tobytes(), wave.tobytes(), "naïve text ".encode() * 300, spikes.tobytes(),
            rng.integers(100, 104, 5_000, dtype=np.uint8).tobytes(), np.arange(4_000).astype(np.uint8).tobytes(), b"x" * 576 * 200]
    return [flac.payload_of(r) for r in raws]


@pytest.mark.parametrize("partition_order", [0, 2, 4])
def test_flac_round_trip(partition_order):
    given = some_payloads()
    streams = flac.encode(given, partition_order)
    back, offsets, codes = flac.decode(streams)
    assert back == given and {0, 1, 33} <= set(codes.tolist()) and codes.max() >= 32
    for stream, alone, places in zip(streams, given, offsets, strict=True):
        assert flac.decode([stream])[0] == [alone] and len(places) * flac.BLOCK == len(alone)


def test_flac_finds_damage():
    stream = flac.encode([flac.payload_of(b"some text to store " * 200)])[0]
    for at in (60, len(stream) - 1, len(stream) - 300):
        broken = bytearray(stream)
        broken[at] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


class BitWriter:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, value, k):
        folded = value << 1 if value >= 0 else (-value << 1) - 1
        self.bits += "0" * (folded >> k) + "1"
        self.put(folded, k)


def slow_crc(data, bits, polynomial):
    crc = 0
    for byte in data:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (polynomial if crc >> (bits - 1) & 1 else 0)
        crc &= (1 << bits) - 1
    return crc


def test_flac_reads_what_its_own_encoder_never_writes():
    """A frame written bit by bit: third-order prediction of four weights, an escaped partition, long unary codes, five-bit parameters."""
    rng = np.random.default_rng(4)
    x = np.clip(np.cumsum(rng.integers(-6, 7, 576)) % 160 - 80, -128, 127).tolist()
    frames = []
    for form in ("fixed3", "lpc4"):
        w = BitWriter()
        order, weights, shift = (3, (3, -3, 1), 0) if form == "fixed3" else (4, (700, -150, 30, -100), 9)
        w.put((8 + order if form == "fixed3" else 32 + order - 1) << 1, 8)
        for v in x[:order]:
            w.put(v, 8)
        if form == "lpc4":
            w.put(11, 4)
            w.put(shift, 5)
            for a in weights:
                w.put(a, 12)
        residual = [x[t] - (sum(a * x[t - 1 - k] for k, a in enumerate(weights)) >> shift) for t in range(order, 576)]
        w.put(1 if form == "lpc4" else 0, 2)
        w.put(2, 4)
        wide = 5 if form == "lpc4" else 4
        for part in range(4):
            mine = residual[max(0, part * 144 - order):(part + 1) * 144 - order]
            if part == 1:
                w.put((1 << wide) - 1, wide)
                w.put(12, 5)
                for v in mine:
                    w.put(v, 12)
            else:
                k = (0, 0, 2, 7)[part]
                w.put(k, wide)
                for v in mine:
                    w.rice(v, k)
        w.bits += "0" * (-len(w.bits) % 8)
        head = bytes([0xFF, 0xF8, 0x20, 0x02, len(frames)])
        frame = head + bytes([slow_crc(head, 8, 0x07)]) + int(w.bits, 2).to_bytes(len(w.bits) // 8, "big")
        frames.append(frame + slow_crc(frame, 16, 0x8005).to_bytes(2, "big"))
    samples = bytes(v + 128 for v in x) * 2
    own = flac.encode([samples])[0]
    _, _, _, first = flac._metadata(own)
    table = (0).to_bytes(16, "big") + flac.BLOCK.to_bytes(2, "big") + flac.BLOCK.to_bytes(8, "big") + len(frames[0]).to_bytes(8, "big") + flac.BLOCK.to_bytes(2, "big")
    stream = own[:first - len(table)] + table + b"".join(frames)
    back, _, codes = flac.decode([stream])
    assert back == [samples] and codes.tolist() == [11, 35]


def test_flac_digests(both, empty):
    want = []
    for r in both.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    media = flac.store_media(both)
    got = [tuple(r) for r in flac.media_digests(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    blocks = flac.pcm_blocks(media.filter("doc_id = 1000018"))
    assert b"".join(r.pcm for r in blocks.orderBy("block").collect())[:12] == ("naïve " * 2).encode()[:12]
    assert [r.first_sample for r in blocks.orderBy("block").limit(3).collect()] == [0, 576, 1152]
    assert flac.media_digests(flac.store_media(empty)).count() == 0


# 10: tool calls


def brute_calls(rows):
    """Calls out of plain conversations, as documented in toolcalls."""
    asked, answered = {}, {}
    for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn)):
        if r.role == "user":
            words = len((r.text or "").split())
            name = ("search", "translate", "summarise")[((r.conv_id or 0) + r.turn // 2) % 3]
            args = {"search": {"limit": words, "query": r.text}, "translate": {"text": r.text, "formal": r.turn % 4 < 2},
                    "summarise": {"share": words / (words + 10), "text": r.text}}[name]
            half = r.turn // 2
            before = half - (r.turn - half) % 2
            asked[r.conv_id, r.turn] = (name, args, before if 0 <= before < r.turn else None)
        if r.role == "assistant":
            answered[r.conv_id, r.turn - 1] = r.text

    def level(conv, turn):
        if (conv, turn) not in asked:
            return None
        before = asked[conv, turn][2]
        if before is None:
            return 0
        up = level(conv, before)
        return None if up is None else up + 1

    out = []
    for (conv, turn), (name, args, _) in asked.items():
        text = args.get("text", args.get("query"))
        least, most = {"search": (1, 400), "translate": (1, 1e9), "summarise": (100, 1e9)}[name]
        errors = ["missing: " + ("query" if name == "search" else "text")] if text is None else []
        if text is not None and not least <= len(text) <= most:
            errors.append("bounds: " + ("query" if name == "search" else "text"))
        if name == "search" and not 1 <= args["limit"] <= 40:
            errors.append("bounds: limit")
        if name == "summarise" and args["share"] > 0.75:
            errors.append("bounds: share")
        out.append((conv, turn, name, level(conv, turn), (conv, turn) in answered, tuple(sorted(errors))))
    return sorted(out)


def test_calls_in_conversations(spark):
    given = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    found = QUERIES["op10_tool_calls"](spark, FOLDER).collect()
    got = [(r.conv_id, r.turn, r.name, r.level, r.linked, tuple(r.errors.split(", ")) if r.errors else ()) for r in found]
    rows = given.collect()
    assert sorted(got) == brute_calls(rows)
    texts = {(r.conv_id, r.turn): r.text for r in rows}
    for r in found:
        value = json.loads(r.json)
        assert list(value) == sorted(value) and value["id"] == r.call_id and value["result"] == texts.get((r.conv_id, r.turn + 1)) * r.linked if r.linked else True
        arguments = json.loads(value["arguments"])
        assert json.dumps(arguments, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == value["arguments"] or "share" in arguments


def test_odd_calls(spark):
    calls = spark.createDataFrame([
        (1, 1, "a", "t", '{"z": 1, "n": 2.50, "s": "é\\n", "b": [1, {"y": 1, "x": null}]}', [], "own"), (1, 2, "b", "t", '{"n": 3, "s": "x"}', ["a"], "own"),
        (1, 3, "c", "t", '{"n": "3", "s": null}', ["b", "a", "a", None], "own"), (1, 4, "d", "t", "[1]", ["zzz"], "own"), (1, 5, "e", "t", "{oops", ["f"], "own"),
        (1, 6, "f", "t", None, ["e"], "own"), (2, 1, "g", "unknown", "{}", None, "own"), (2, 1, None, "t", "{}", [], "own"), (None, None, "h", "t", '{"n": 99, "s": "long"}', ["c"], "own"),
        (1, 9, "a", "t", "{}", ["h"], "own"), (1, 1, "i", "t", '{"n": 1, "s": "x"}', ["e"], "own")],
        "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, level string")
    results = spark.createDataFrame([("a", 2, "late", "x"), ("a", 2, "early", "x"), ("zz", 1, "no call", "x"), (None, 1, "no id", "x"), ("b", None, None, "x")],
                                    "call_id string, turn long, content string, errors string")
    schemas = spark.sql("VALUES ('t', 'n', 'number', true, 0D, 10D), ('t', 's', 'string', true, 1D, 3D), ('t', 'b', 'boolean', false, NULL, NULL) AS s(name, param, kind, required, least, most)")
    found = {r.call_id: r for r in toolcalls.link_calls(calls, results, schemas).collect()}
    assert set(found) == set("abcdefghi")
    assert {k: r.level for k, r in found.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "g": 0, "h": 3, "i": None}
    assert {k: list(r.errors) for k, r in found.items()} == {
        "a": ["extra: z", "kind: b"], "b": [], "c": ["kind: n", "missing: s"], "d": ["arguments: no object"], "e": ["arguments: no object"],
        "f": ["arguments: no object"], "g": ["tool: unknown"], "h": ["bounds: n", "bounds: s"], "i": []}
    assert {k for k, r in found.items() if r.linked} == {"a", "b"}
    a = json.loads(found["a"].json)
    assert a["result"] == "early" and a["arguments"] == '{"b":[1,{"x":null,"y":1}],"n":2.5,"s":"é\\n","z":1}'
    assert json.loads(found["c"].json)["waits_for"] == ["a", "b"] and json.loads(found["e"].json)["arguments"] == "null"
    assert toolcalls.link_calls(calls.limit(0), results, schemas).count() == 0
    assert toolcalls.link_calls(calls, results.limit(0), schemas.limit(0)).filter("linked").count() == 0


def test_levels_of_long_chains_and_branches(spark, monkeypatch):
    """Chains, calls that wait for several, cycles and unknown calls against a plain loop; a chain of 200 takes few stages."""
    rng = np.random.default_rng(3)
    after = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(200)}
    for k in range(300):
        size = int(rng.choice([0, 1, 1, 1, 1, 2, 3]))
        after[f"r{k}"] = [f"r{int(x)}" for x in rng.integers(max(0, k - 12), max(k, 1), size)] if k else []
    after |= {"x": ["y"], "y": ["z"], "z": ["x"], "in": ["z", "c3"], "self": ["self"], "lost": ["nobody"], "behind": ["lost", "c1", "c1"], "top": ["c199", "r0"], "over": ["top"]}
    want, grown = {}, True
    while grown:
        new = {c: max((want[w] for w in a), default=-1) + 1 for c, a in after.items() if c not in want and all(w in want for w in a)}
        want, grown = want | new, bool(new)
    made, stored = [], toolcalls.stored
    monkeypatch.setattr(toolcalls, "stored", lambda df: made.append(1) or stored(df))
    rows = spark.createDataFrame(list(after.items()), "call_id string, after array<string>")
    assert {r.call_id: r.level for r in toolcalls.levels(rows).collect()} == want
    chain = rows.filter("call_id LIKE 'c%'")
    made.clear()
    assert {r.call_id: r.level for r in toolcalls.levels(chain).collect()} == {c: v for c, v in want.items() if c[0] == "c"}
    assert len(made) <= 12


def test_calls_of_unknown_conversations_are_kept(spark, tmp_path):
    """NULL conv_id and NULL turn: the query's rows are those of its SQL twin."""
    import duckdb

    rows = [(c, t, role, f"{role} says {'many words ' * 20}{t}") for c in (1, 12, None, None, None) for t in (0, 2, 12) for role in ("user",)]
    rows += [(c, t, "assistant", f"answer {t}") for c in (1, 12, None, None) for t in (1, 3, 13)]
    rows += [(12, None, "user", "no turn"), (12, None, "user", None), (12, None, "assistant", "x"), (None, None, "user", "neither"), (None, 4, "user", None)]
    folder = tmp_path / "given"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    found = QUERIES["op10_tool_calls"](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    twin = con.sql(ORACLES["op10_tool_calls"])
    got = [tuple(r) for r in found.select(*twin.columns).collect()]
    assert len(got) == sum(r[2] == "user" for r in rows) and found.columns == list(twin.columns)
    cut = [k for k, c in enumerate(twin.columns) if c != "json"]
    assert sorted(([r[k] for k in cut] for r in got), key=repr) == sorted(([r[k] for k in cut] for r in twin.fetchall()), key=repr)


def test_ids_hold_within_a_conversation(spark):
    given = [(1, 1, "a", []), (1, 2, "b", ["a"]), (2, 5, "a", ["b"]), (2, 4, "b", []), (None, 1, "a", []), (None, 2, "b", ["a"]), (None, 7, "b", []),
             (2, 6, "a", []), (2, 6, "a", []), (3, 1, None, []), (3, None, "a", ["a "]), (3, None, "b", [])]
    calls = spark.createDataFrame([(c, t, i, "t", "{}", w) for c, t, i, w in given], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "a", 2, "one"), (2, "a", 6, "two"), (None, "b", 3, "none"), (4, "a", 1, "nobody")], "conv_id long, call_id string, turn long, content string")
    schemas = spark.sql("VALUES ('t', 'n', 'number', false, 0D, 10D) AS s(name, param, kind, required, least, most)")
    found = toolcalls.link_calls(calls, results, schemas).collect()
    got = sorted(((r.conv_id, r.turn, r.call_id, r.level, r.duplicate, json.loads(r.json)["result"]) for r in found), key=repr)
    assert got == sorted([
        (1, 1, "a", 0, False, "one"), (1, 2, "b", 1, False, None), (2, 5, "a", 1, False, "two"), (2, 4, "b", 0, False, None),
        (None, 1, "a", 0, False, None), (None, 2, "b", 1, False, "none"), (None, 7, "b", None, True, None), (2, 6, "a", None, True, None),
        (2, 6, "a", None, True, None), (3, 1, None, None, False, None), (3, None, "a", None, False, None), (3, None, "b", 0, False, None)], key=repr)
    assert all(r.linked == (json.loads(r.json)["result"] is not None) and r.n_errors == 0 for r in found)


# The pipeline


def test_pipeline_stages(spark, both, empty):
    docs = both
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, FOLDER)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns, name
        docs = corpus_pipeline.stored(after)
        assert 0 < docs.count() <= both.count()
    assert docs.filter("copies < 1 OR copies > 3").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    """Of the given documents, those that are no copy, hold no benchmark words and no line of several others stay as they are."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, out, FOLDER))
    kept = {r.doc_id: r for r in out.collect()}
    lost = [r for r in docs.collect() if r.doc_id not in kept]
    assert len(kept) > 0.6 * docs.count() and len(lost) > 0
    assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in kept.values())
    assert corpus_pipeline.run(spark, FOLDER).filter(F.col("doc_id").isNull()).count() == 0


def test_line_twin(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = sorted(con.sql(ORACLES["op6_line_dedup"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op6_line_dedup"](spark, FOLDER).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want
