"""Tool calls in chat data, in DataFrame operations only: link results by identifier, order calls, validate arguments, serialise.

A call may name calls it waits for. Its level is 0 without any, else one more than the highest of those. A call that waits for one
other hangs on it: pointers along such chains are doubled, so their rounds grow with the logarithm of their length. Calls that
wait for several are then taken off round by round, as many rounds as a path has such calls. Calls in or behind a
cycle, or that wait for a call that does not exist, get no level. (level, turn, call_id) is a topological order of a
conversation; no conversation is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutwise.llm.common import discard, stored


def hung(calls: DataFrame) -> DataFrame:
    """call_id, at, hops, settled for the calls (call_id, after) that wait for one other.

    `at` is the first call up the chain that does not itself wait for exactly one, or that does not exist; it is `hops` calls away. Where
    the chain ends in a cycle, `settled` is false.
    """
    chain = calls.filter(F.size("after") == 1).select("call_id", F.col("after")[0].alias("at"))
    more = chain.select(F.col("call_id").alias("at"), F.lit(False).alias("settled"))
    out = stored(chain.join(more, "at", "left").select("call_id", "at", F.lit(1).alias("hops"), F.coalesce("settled", F.lit(True)).alias("settled")))
    before = -1
    while True:
        row = out.agg(F.count("*").alias("n"), F.count_if("settled").alias("settled")).first()
        if row.settled in (row.n, before):  # a round that settles nothing leaves only cycles and what hangs on them
            return out
        before = row.settled
        step = out.select(F.col("call_id").alias("at"), F.col("at").alias("to"), F.col("hops").alias("on"), F.col("settled").alias("then"))
        doubled = out.filter("NOT settled").join(step, "at").select("call_id", F.col("to").alias("at"), (F.col("hops") + F.col("on")).alias("hops"), F.col("then").alias("settled"))
        last, out = out, stored(out.filter("settled").unionByName(doubled))
        discard(last)


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level for the calls (call_id, after: array of call_ids) that can be ordered; ids are unique and not NULL."""
    calls = stored(calls.select("call_id", F.array_distinct(F.array_compact("after")).alias("after")))
    waits = F.coalesce(F.size("after"), F.lit(0))
    pointers = hung(calls)
    ends = pointers.filter("settled").select(F.col("call_id").alias("waits_for"), "at", "hops")
    # What a call of several waits for is its anchor up the chain, and how much higher the call is at least.
    edges = stored(calls.filter(waits > 1).select("call_id", F.explode("after").alias("waits_for")).join(ends, "waits_for", "left").select(
        "call_id", F.coalesce("at", "waits_for").alias("on"), (F.coalesce("hops", F.lit(0)) + 1).alias("gain"), F.lit(None).cast("int").alias("least")))
    front = found = calls.filter(waits <= 0).select("call_id", F.lit(0).alias("level"))
    while not edges.isEmpty():
        reached = front.select(F.col("call_id").alias("on"), "level")
        last, edges = edges, stored(edges.join(reached, "on", "left").select(
            "call_id", "on", "gain", F.coalesce("least", F.col("level") + F.col("gain")).alias("least")))
        discard(last)
        front = stored(edges.groupBy("call_id").agg(F.max("least").alias("level"), F.count_if(F.col("least").isNull()).alias("open")).filter("open = 0").select("call_id", "level"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        last, edges = edges, stored(edges.join(front.select("call_id"), "call_id", "left_anti"))
        discard(last)
    above = found.select(F.col("call_id").alias("at"), F.col("level").alias("base"))
    return found.unionByName(pointers.filter("settled").join(above, "at").select("call_id", (F.col("base") + F.col("hops")).alias("level")))


#: What a schema may ask of a parameter, as the types of parsed JSON.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "DECIMAL", "boolean": "BOOLEAN"}


def _kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL (any other number), BOOLEAN, VOID, OBJECT or ARRAY."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name.isin("DOUBLE", "FLOAT"), "DECIMAL").otherwise(name)


def argument_errors(arguments: Column, parameters: Column) -> Column:
    """Sorted errors of JSON arguments (text) against an array of (param, kind, required, least, most).

    Text that is not a JSON object is one error. Extra, missing and NULL parameters, wrong kinds and numbers out of bounds
    (a string's bounds are of its length) are one error each. A tool without schema is one error.
    """
    values = F.from_json(arguments, "map<string,variant>", {"mode": "PERMISSIVE"})
    names = F.transform(parameters, lambda p: p["param"])

    def check(p: Column) -> Column:
        value = F.try_element_at(values, p["param"])
        kind = _kind(value)
        missing = value.isNull() | (kind == "VOID")
        fits = (kind == p["kind"]) | ((p["kind"] == "DECIMAL") & (kind == "BIGINT"))
        size = F.when(kind == "STRING", F.char_length(F.try_variant_get(value, "$", "string")).cast("double")).otherwise(
            F.try_variant_get(value, "$", "double"))
        return F.when(missing, F.when(p["required"], F.concat(F.lit("missing: "), p["param"]))).when(
            ~fits, F.concat(F.lit("kind: "), p["param"])).when(
            (size < p["least"]) | (size > p["most"]), F.concat(F.lit("bounds: "), p["param"]))

    extra = F.transform(F.array_except(F.map_keys(values), names), lambda name: F.concat(F.lit("extra: "), name))
    all_ = F.array_sort(F.array_compact(F.concat(F.transform(parameters, check), extra)))
    return F.when(parameters.isNull(), F.array(F.lit("tool: unknown"))).when(
        values.isNull() | F.map_keys(values).isNull(), F.array(F.lit("arguments: no object"))).otherwise(all_)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, turn, call_id, name, level, linked, n_errors, errors, duplicate, json.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of call_ids). results: conv_id, call_id, turn, content.
    schemas: name, param, kind (a key of KINDS), required, least, most. An id holds within its conversation; calls with NULL conv_id
    count as one. Of several calls with one id the first by turn (then by name, arguments and after) is ordered and linked, the
    others are marked as duplicate; of several results the first by turn (then content) counts. Duplicates and calls without id
    have no level and no result. Results without a call are left out. json has sorted keys and no blanks; NULLs are written.

    Where results have no conv_id, an id holds in the whole table: calls and results are linked across
    conversations, and duplicates and calls without id are left out.
    """
    within = ["conv_id"] if "conv_id" in results.columns else []
    key = F.struct(*within, "call_id").alias("key")  # equal where the same parts are NULL
    calls = stored(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after", F.monotonically_increasing_id().alias("row")))
    first = calls.filter("call_id IS NOT NULL").groupBy(key).agg(F.min(F.struct("turn", "name", "arguments", "after", "row")).alias("r"))
    first = stored(first.select("key", "r.row", F.transform(F.array_compact("r.after"), lambda x: F.struct(*[F.col(f"key.{c}") for c in within], x.alias("call_id"))).alias("after")))
    level = levels(first.select(F.col("key").alias("call_id"), "after")).withColumnRenamed("call_id", "key")
    answers = results.filter("call_id IS NOT NULL").groupBy(key).agg(F.min(F.struct("turn", "content")).alias("r")).select("key", "r.content", F.lit(True).alias("answered"))
    firsts = first.select("key", "row").join(level, "key", "left").join(answers, "key", "left").drop("key").withColumn("counted", F.lit(True))
    parameters = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(
        "param", F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("kind")).alias("kind"), "required",
        F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most")))).alias("parameters"))
    parameters = parameters.withColumnRenamed("name", "tool")
    rows = calls.join(firsts, "row", "left").join(parameters, F.col("name").eqNullSafe(F.col("tool")), "left")
    rows = rows.withColumns({
        "errors": argument_errors(F.col("arguments"), F.col("parameters")), "linked": F.coalesce("answered", F.lit(False)),
        "duplicate": F.col("call_id").isNotNull() & F.col("counted").isNull()})
    if not within:
        rows = rows.filter("counted")
    text = F.to_json(F.struct(
        F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null")).alias("arguments"), "conv_id", "errors", F.col("call_id").alias("id"), "level", "name",
        F.col("content").alias("result"), "turn", F.array_sort(F.array_distinct(F.array_compact("after"))).alias("waits_for")), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "turn", "call_id", "name", "level", "linked", F.size("errors").cast("long").alias("n_errors"), "errors", "duplicate", text.alias("json"))


#: Three tools that the turns of a conversation are read as calls of, and what is asked of turns whose place is unknown: name,
#: param, kind, required, least, most.
TOOLS = """VALUES
  ('search', 'query', 'string', true, 1D, 400D), ('search', 'limit', 'integer', true, 1D, 40D), ('search', 'exact', 'boolean', false, NULL, NULL),
  ('translate', 'text', 'string', true, 1D, NULL), ('translate', 'formal', 'boolean', true, NULL, NULL),
  ('summarise', 'text', 'string', true, 100D, NULL), ('summarise', 'share', 'number', true, 0D, 0.75D),
  (NULL, 'text', 'string', true, NULL, NULL), (NULL, 'share', 'number', true, NULL, NULL)
  AS tools(name, param, kind, required, least, most)"""


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations (conv_id, turn, role, text).

    A user's turn is a call, of the tool its place picks, with arguments made from its text; it waits for the call at half its
    turn (the even or odd turn below, as its own is). An assistant's turn is the result of the turn before it. Turns of an unknown
    conversation, or without number, are calls without id and tool: nothing can be linked to them.
    """
    conv = F.col("conv_id").cast("string")
    half = F.floor(F.col("turn") / 2)
    before = half - F.pmod(F.col("turn") - half, F.lit(2))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    name = F.get(F.array(*(F.lit(t) for t in ("search", "translate", "summarise"))), F.pmod(F.col("conv_id") + F.floor(F.col("turn") / 2), F.lit(3)).cast("int"))
    arguments = F.when(name == "search", F.to_json(F.struct(words.alias("limit"), F.col("text").alias("query")), {"ignoreNullFields": "false"})).when(
        name == "translate", F.to_json(F.struct(F.col("text").alias("text"), (F.pmod("turn", F.lit(4)) < 2).alias("formal")), {"ignoreNullFields": "false"})).otherwise(
        F.to_json(F.struct((words / (words + 10.0)).alias("share"), F.col("text").alias("text")), {"ignoreNullFields": "false"}))
    calls = conversations.filter("role = 'user'").select(
        "conv_id", "turn", F.concat(conv, F.lit("-"), F.col("turn").cast("string")).alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.when((before >= 0) & (before < F.col("turn")), F.array(F.concat(conv, F.lit("-"), before.cast("string")))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = conversations.filter("role = 'assistant'").select(
        "conv_id", F.concat(conv, F.lit("-"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def format_conversations(conversations: DataFrame) -> DataFrame:
    """`link_calls` over the calls read out of `conversations`, with the three tools above."""
    calls, results = calls_of(conversations)
    return link_calls(calls, results, conversations.sparkSession.sql(TOOLS))
