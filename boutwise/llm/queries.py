"""The registered queries of the corpus operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutwise.llm import align, decontaminate, flac, html, language, lines, mixing, pieces, search, simhash, substrings, tokens, toolcalls
from boutwise.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op2_mix_sources")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


@query("op4_flac")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(flac.store_media(table(spark, sf_dir, "documents")))


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.predict_language(docs, learned).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


#: The contract's blanks, and A-Z to a-z.
LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM documents)),
often AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, o.key IS NOT NULL AND l.doc_id <> o.keeper AS gone FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SUBSTRINGS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win FROM d, unnest(range(1, len(w) - 33)) AS r(i)),
again AS (SELECT doc_id, i FROM windows WHERE win IN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(i, i + 35)) AS r(p)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op7_substring_dedup", SUBSTRINGS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


BENCHMARK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT *, least(10, len(w)) AS size FROM b WHERE len(w) > 0), unnest(range(1, len(w) - size + 2)) AS r(i)),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM d, (SELECT DISTINCT size FROM bw), unnest(range(1, len(w) - size + 2)) AS r(i)),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op9_decontaminate", BENCHMARK_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


CALLS_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, conv_id || '-' || turn AS call_id, ['search', 'translate', 'summarise'][CAST((conv_id + turn // 2) % 3 + 1 AS INT)] AS name,
   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn // 2 - (turn - turn // 2) % 2 AS before FROM conversations WHERE role = 'user'),
a AS (SELECT *, CASE WHEN before >= 0 AND before < turn THEN conv_id || '-' || before END AS after, CASE name WHEN 'search' THEN CAST(to_json(struct_pack("limit" := words, query := text)) AS VARCHAR)
   WHEN 'translate' THEN CAST(to_json(struct_pack(formal := turn % 4 < 2, text := text)) AS VARCHAR)
   ELSE CAST(to_json(struct_pack(share := words / (words + 10.0), text := text)) AS VARCHAR) END AS arguments FROM c),
lv AS (SELECT call_id, 0 AS level FROM a WHERE after IS NULL UNION ALL SELECT a.call_id, lv.level + 1 FROM a JOIN lv ON a.after = lv.call_id),
r AS (SELECT conv_id || '-' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
e AS (SELECT a.*, level, r.call_id IS NOT NULL AS linked, content, list_sort(list_filter([
   CASE WHEN name = 'search' AND words NOT BETWEEN 1 AND 40 THEN 'bounds: limit' END, CASE WHEN name = 'summarise' AND words / (words + 10.0) > 0.75 THEN 'bounds: share' END,
   CASE WHEN text IS NULL THEN 'missing: ' || CASE WHEN name = 'search' THEN 'query' ELSE 'text' END
        WHEN name = 'search' AND length(text) NOT BETWEEN 1 AND 400 THEN 'bounds: query' WHEN name = 'translate' AND length(text) < 1 OR name = 'summarise' AND length(text) < 100 THEN 'bounds: text' END
   ], lambda x: x IS NOT NULL)) AS errors FROM a LEFT JOIN lv USING (call_id) LEFT JOIN r USING (call_id))
SELECT conv_id, turn, call_id, name, level, linked, CAST(len(errors) AS BIGINT) AS n_errors, array_to_string(errors, ', ') AS errors, CAST(to_json(struct_pack(arguments := arguments, conv_id := conv_id,
  errors := errors, id := call_id, level := level, name := name, result := content, turn := turn, waits_for := CASE WHEN after IS NULL THEN [] ELSE [after] END)) AS VARCHAR) AS json FROM e
"""


@query("op10_tool_calls", CALLS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_conversations(table(spark, sf_dir, "conversations")).withColumn("errors", F.array_join("errors", ", ")).drop("duplicate")


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
c AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
t AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, c GROUP BY term, docs),
scores AS (SELECT item_id, row, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN weights USING (term), c GROUP BY item_id, row, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_lexical_search", SEARCH_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_align_tokens")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokens(table(spark, sf_dir, "documents"))


@query("op13_sentencepiece")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
