"""Operator 10: chat formatting with linked tool calls. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import scratch, stored

#: A call is {"id", "name", "arguments"}, a result {"id", "content"}, each JSON between these marks in a text.
CALL_MARKS = ("<tool_call>", "</tool_call>")
RESULT_MARKS = ("<tool_result>", "</tool_result>")
#: An argument {"$ref": id} stands for the result of another call of the conversation.
REFERENCE = r'"\$ref"\s*:\s*"((?:[^"\\]|\\.)*)"'
#: Argument schemas of the query: tool, argument, type of its JSON value, whether it must be there.
SCHEMAS = (
    ("search", "query", "string", True),
    ("search", "limit", "number", False),
    ("calculator", "expression", "string", True),
    ("fetch", "url", "string", True),
    ("run_code", "language", "string", True),
    ("run_code", "code", "string", True),
)
ROLES = ("system", "user", "assistant", "tool")


def _between(text: Column, marks: tuple[str, str]) -> Column:
    return F.when(F.contains(text, F.lit(marks[0])), F.regexp_extract_all(text, F.lit(f"(?s){marks[0]}(.*?){marks[1]}"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def canonical(raw: Column) -> Column:
    """JSON with sorted keys and no blanks, or null where it isn't valid JSON. A variant keeps keys in order."""
    return F.to_json(F.try_parse_json(raw))


def _levels(calls: DataFrame, references: DataFrame) -> DataFrame:
    """Topological level of every call (conv, call): one more than the highest level it refers to.

    Calls with one reference form chains. Each follows its pointer to where a chain begins, and the
    pointers double their length from round to round, so a chain of n calls takes about log n
    rounds. What then remains are calls with several references: each round places those all of
    whose references are placed, so there are as many rounds as such calls follow each other. What
    is never placed lies on or behind a cycle and gets null.
    """
    key = ["conv", "call"]
    known = stored(references.join(calls.select("conv", F.col("call").alias("needs")), ["conv", "needs"], "left_semi").select("conv", "call", "needs"), "chat-references")
    degree = known.groupBy(*key).agg(F.count(F.lit(1)).alias("degree"))
    pointers = stored(known.join(degree.filter("degree = 1"), key, "left_semi").withColumn("steps", F.lit(1)), "chat-pointers")
    for _ in range(pointers.count().bit_length() + 1):
        further = pointers.select("conv", F.col("call").alias("needs"), F.col("needs").alias("next"), F.col("steps").alias("more"))
        joined = stored(pointers.join(further, ["conv", "needs"], "left"), "chat-jumps")
        if joined.filter("next is not null").isEmpty():
            break
        pointers = joined.select("conv", "call", F.coalesce("next", "needs").alias("needs"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    begins = pointers.select("conv", F.col("call").alias("needs"), F.col("needs").alias("next"), F.col("steps").alias("more"))
    several = known.join(degree.filter("degree > 1"), key, "left_semi").join(begins, ["conv", "needs"], "left")
    waiting = stored(several.select("conv", "call", F.coalesce("next", "needs").alias("needs"), (F.coalesce("more", F.lit(0)) + 1).alias("steps")), "chat-several")
    placed = stored(calls.select(*key).join(degree, key, "left_anti").withColumn("level", F.lit(0)), "chat-level")
    while not waiting.isEmpty():
        on = waiting.join(placed.select("conv", F.col("call").alias("needs"), "level"), ["conv", "needs"], "left")
        found = on.groupBy(*key).agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("steps")).alias("level"))
        found = stored(found.filter("open = 0").select(*key, "level"), "chat-found")
        if found.isEmpty():
            break
        placed = stored(placed.unionByName(found), "chat-level")
        waiting = stored(waiting.join(found, key, "left_anti"), "chat-several")
    chained = pointers.join(placed.select("conv", F.col("call").alias("needs"), "level"), ["conv", "needs"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return calls.select(*key).join(placed.unionByName(chained), key, "left")


def _problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Problems of each call (conv, call) with its schema, as a sorted array of texts."""
    tools = schemas.select(F.col("tool").alias("name")).distinct().withColumn("is_known", F.lit(True))
    schema = schemas.select(F.col("tool").alias("name"), "argument", "type", "required")
    each = calls.select("conv", "call", "name", "arguments", F.from_json("arguments", "map<string,variant>").alias("given")).join(schema, "name")
    kind = F.schema_of_variant(F.try_element_at("given", F.col("argument")))
    matches = (
        F.when(F.col("type") == "string", kind == "STRING")
        .when(F.col("type") == "number", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        .when(F.col("type") == "boolean", kind == "BOOLEAN")
        .when(F.col("type") == "array", kind.startswith("ARRAY"))
        .when(F.col("type") == "object", kind.startswith("OBJECT"))
        .otherwise(F.lit(True))
    )
    reference = kind.rlike(r"^OBJECT<\$ref: STRING>$|^OBJECT<`\$ref`: STRING>$")
    missing = F.try_element_at("given", F.col("argument")).isNull()
    problem = F.when(missing, F.when(F.col("required"), F.concat(F.lit("missing "), "argument"))).when(~matches & ~reference, F.concat_ws(" ", F.lit("not a"), F.col("type"), F.lit("in"), F.col("argument")))
    found = each.select("conv", "call", problem.alias("problem"))
    no_object = F.when(F.from_json("arguments", "map<string,variant>").isNull(), "arguments aren't an object")
    whole = calls.join(tools, "name", "left").select("conv", "call", F.explode(F.array(no_object, F.when(F.col("is_known").isNull(), "unknown tool"))).alias("problem"))
    return found.unionByName(whole).groupBy("conv", "call").agg(F.sort_array(F.collect_set("problem")).alias("problems"))


def format_chat(conversations: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_results, n_invalid and json, its canonical line.

    Conversations stay in rows (order them by conv_id and turn), so no conversation is gathered in
    one task, however long. Tool calls and results found in the texts are exploded and hash-joined
    by conversation and identifier, the first of each by turn and place; calls get a topological
    level from the results that their arguments refer to, are held against the schemas (tool,
    argument, type, required), and return to their message as an array sorted by level and place,
    each with its result. Messages without calls take no part in the joins. Keys of the JSON are
    sorted and blanks left out, in the call's arguments and results too.

    Null text: empty. Null role, or one outside ROLES: "user". Repeated messages: each formatted;
    their calls count once. A call without an id, or with broken JSON, is kept as invalid with
    its raw text. A result that no call asks for stays in its message's text only. Calls on a
    cycle: level null, invalid. Empty table: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = conversations.select(
        F.col("conv_id").alias("conv"), "turn", F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user").alias("role"), text.alias("text"),
        F.xxhash64("role", "text").alias("tie"), _between(text, CALL_MARKS).alias("raw_calls"), _between(text, RESULT_MARKS).alias("raw_results"),
    )
    plain = base.filter((F.size("raw_calls") == 0) & (F.size("raw_results") == 0))
    rich = base.filter((F.size("raw_calls") > 0) | (F.size("raw_results") > 0))
    out = plain.select("conv", "turn", "role", "text", *[F.lit(0).cast("long").alias(n) for n in ("n_calls", "n_results", "n_invalid")], F.lit(None).cast(_CALLS).alias("calls"))
    if not rich.isEmpty():
        with scratch(conversations.sparkSession):
            out = out.unionByName(stored(_with_calls(stored(rich, "chat-rich"), schemas), "chat-result", keep=True))
    calls = F.transform(
        "calls",
        lambda c: F.concat(
            F.lit('{"arguments":'), F.coalesce(c["arguments"], F.lit("null")), F.lit(',"id":'), F.coalesce(_quoted(c["call"]), F.lit("null")), F.lit(',"name":'), F.coalesce(_quoted(c["name"]), F.lit("null")),
            F.lit(',"problems":['), F.array_join(F.transform(c["problems"], _quoted), ","), F.lit('],"result":'), F.coalesce(c["result"], F.lit("null")), F.lit("}"),
        ),
    )
    line = F.concat(
        F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"conv_id":'), F.coalesce(F.col("conv").cast("string"), F.lit("null")), F.lit(',"role":'), _quoted(F.col("role")),
        F.coalesce(F.concat(F.lit(',"tool_calls":['), F.array_join(calls, ","), F.lit("]")), F.lit("")), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "n_calls", "n_results", "n_invalid", line.alias("json"))


_CALLS = "array<struct<level:int,place:int,call:string,name:string,arguments:string,problems:array<string>,result:string>>"


def _quoted(text: Column) -> Column:
    """A JSON string literal; null for null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def _with_calls(rich: DataFrame, schemas: DataFrame) -> DataFrame:
    message = ["conv", "turn", "tie"]
    got = lambda name: F.try_variant_get(F.try_parse_json("raw"), f"$.{name}", "string")
    part = lambda name: F.to_json(F.try_variant_get(F.try_parse_json("raw"), f"$.{name}", "variant"))
    calls = rich.select(*message, F.posexplode("raw_calls").alias("place", "raw")).distinct()
    calls = stored(calls.select(*message, "place", got("id").alias("call"), got("name").alias("name"), F.coalesce(part("arguments"), _quoted(F.col("raw"))).alias("arguments")), "chat-calls")
    results = rich.select(*message, F.posexplode("raw_results").alias("place", "raw")).distinct().select(*message, "place", got("id").alias("call"), part("content").alias("content"))
    results = results.filter("call is not null").groupBy("conv", "call").agg(F.min_by("content", F.struct("turn", "tie", "place")).alias("result"), F.min("turn").alias("answered"))
    named = calls.filter("call is not null")
    first = stored(named.groupBy("conv", "call").agg(F.min(F.struct("turn", "tie", "place", "name", "arguments")).alias("f")).select("conv", "call", "f.*"), "chat-first")
    references = first.select("conv", "call", F.explode(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1))).alias("needs")).distinct()
    facts = first.join(_levels(first, references), ["conv", "call"], "left").join(_problems(first, schemas), ["conv", "call"], "left").join(results, ["conv", "call"], "left")
    facts = facts.select("conv", *[F.col(c).alias(f"f_{c}") for c in ("turn", "tie", "place")], F.col("call"), "level", "problems", "result")
    each = calls.join(facts.withColumnRenamed("conv", "f_conv").withColumnRenamed("call", "f_call"), F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("call") == F.col("f_call")), "left")
    repeated = F.col("call").isNotNull() & ~(F.col("turn").eqNullSafe(F.col("f_turn")) & F.col("tie").eqNullSafe(F.col("f_tie")) & (F.col("place") == F.col("f_place")))
    problems = F.concat(
        F.coalesce("problems", F.array().cast("array<string>")),
        F.when(F.col("call").isNull(), F.array(F.lit("no id"))).otherwise(F.array().cast("array<string>")),
        F.when(repeated, F.array(F.lit("repeated id"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("call").isNotNull() & F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("call").isNotNull() & F.col("result").isNull(), F.array(F.lit("no result"))).otherwise(F.array().cast("array<string>")),
    )
    each = each.select(*message, F.struct(F.col("level"), F.col("place"), F.col("call"), F.col("name"), F.col("arguments"), problems.alias("problems"), F.col("result")).cast(_CALLS[6:-1]).alias("c"))
    listed = each.groupBy(*message).agg(F.sort_array(F.collect_list("c")).alias("calls")).select(*[F.col(m).alias(f"l_{m}") for m in message], "calls")
    on = [F.col(m).eqNullSafe(F.col(f"l_{m}")) for m in message]
    joined = rich.join(listed, on[0] & on[1] & on[2], "left")
    return joined.select(
        "conv", "turn", "role", "text", F.size("raw_calls").cast("long").alias("n_calls"), F.size("raw_results").cast("long").alias("n_results"),
        F.coalesce(F.size(F.filter("calls", lambda c: F.size(c["problems"]) > 0)), F.lit(0)).cast("long").alias("n_invalid"), "calls",
    )


def with_derived_calls(conversations: DataFrame) -> DataFrame:
    """Conversations whose texts end with tool calls and results made up from conv_id and turn.

    An assistant's turn calls "c" and its turn, in six forms by (7 conv_id + turn) mod 6: with valid
    arguments, with a wrong or a missing one, of an unknown tool, with references to calls of two
    and four turns before; some also call "d" and the turn, which stands first and refers to the
    other call. Other turns answer calls of the turn before, but not all. Keys stand unsorted and
    with blanks. Null conv_id or turn: no call.
    """
    t, conv = F.col("turn"), F.col("conv_id")
    form = F.pmod(conv * 7 + t, F.lit(6))
    refer = lambda back: F.concat(F.lit('{"$ref": "c'), t - back, F.lit('"}'))
    arguments = (
        F.when(form == 0, F.concat(F.lit('{"query": "q'), t, F.lit('", "limit": '), t, F.lit("}")))
        .when(form == 1, F.concat(F.lit('{"expression": "'), t, F.lit("+"), conv, F.lit('"}')))
        .when(form == 2, F.concat(F.lit('{"query": '), refer(2), F.lit(', "limit": "'), t, F.lit('"}')))
        .when(form == 3, "{}")
        .when(form == 4, F.concat(F.lit('{"query": '), refer(2), F.lit(', "limit": '), refer(4), F.lit("}")))
        .otherwise('{"to": "x"}')
    )
    name = F.when(form == 1, "calculator").when(form == 5, "teleport").otherwise("search")
    call = lambda mark, name, arguments: F.concat(F.lit('\n<tool_call>{"name": "'), name, F.lit(f'", "id": "{mark}'), t, F.lit('", "arguments": '), arguments, F.lit("}</tool_call>"))
    result = lambda mark, content: F.concat(F.lit(f'\n<tool_result>{{"id": "{mark}'), t - 1, F.lit('", "content": '), content, F.lit("}</tool_result>"))
    calls = F.concat(F.when(form < 2, call("d", F.lit("fetch"), F.concat(F.lit('{"url": '), refer(0), F.lit("}")))).otherwise(""), call("c", name, arguments))
    answers = F.concat(
        F.when(F.pmod(conv + t, F.lit(4)) != 0, result("c", F.concat(F.lit('{"turn": '), t, F.lit(', "ok": true}')))).otherwise(""),
        F.when(F.pmod(t, F.lit(2)) == 0, result("d", t.cast("string"))).otherwise(""),
    )
    added = F.when(F.col("role") == "assistant", calls).when(t > 0, answers)
    return conversations.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.coalesce(added, F.lit(""))))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """Canonical lines of all conversations, with tool calls derived from their rows."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("tool", "argument", "type", "required"), x, strict=True)]) for x in SCHEMAS]
    schemas = spark.range(1).select(F.inline(F.array(*rows)))
    return format_chat(with_derived_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), schemas)


OP10_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role = 'assistant', false) AS asks, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role ELSE 'user' END AS role,
         coalesce(text, '') AS body, (7 * conv_id + turn) % 6 AS form, turn::VARCHAR AS t FROM conversations),
c AS (
  SELECT conv_id, turn, (form < 2)::INT AS place, 'c' || t AS call, CASE form WHEN 1 THEN 'calculator' WHEN 5 THEN 'teleport' ELSE 'search' END AS name,
         CASE form WHEN 0 THEN '{"query": "q' || t || '", "limit": ' || t || '}' WHEN 1 THEN '{"expression": "' || t || '+' || conv_id || '"}'
           WHEN 2 THEN '{"query": {"$ref": "c' || (turn - 2) || '"}, "limit": "' || t || '"}' WHEN 3 THEN '{}'
           WHEN 4 THEN '{"query": {"$ref": "c' || (turn - 2) || '"}, "limit": {"$ref": "c' || (turn - 4) || '"}}' ELSE '{"to": "x"}' END AS given
  FROM m WHERE asks
  UNION ALL SELECT conv_id, turn, 0, 'd' || t, 'fetch', '{"url": {"$ref": "c' || t || '"}}' FROM m WHERE asks AND form < 2),
argument AS (SELECT c.*, u.k AS k, json_extract(given, '$."' || u.k || '"') AS v FROM c, unnest(json_keys(given)) AS u(k)),
refs AS (SELECT DISTINCT a.conv_id, a.call, v->>'$."$ref"' AS needs FROM argument a JOIN c ON c.conv_id = a.conv_id AND c.call = a.v->>'$."$ref"'),
walk(conv_id, call, level) AS (
  SELECT conv_id, call, 0 FROM c UNION SELECT refs.conv_id, refs.call, level + 1 FROM walk JOIN refs ON refs.conv_id = walk.conv_id AND refs.needs = walk.call),
levels AS (SELECT conv_id, call, max(level) AS level FROM walk GROUP BY ALL),
r AS (
  SELECT conv_id, turn, 'c' || (turn - 1) AS call, '{"ok":true,"turn":' || t || '}' AS content, '{"turn": ' || t || ', "ok": true}' AS raw FROM m WHERE NOT asks AND turn > 0 AND (conv_id + turn) % 4 <> 0
  UNION ALL SELECT conv_id, turn, 'd' || (turn - 1), t, t FROM m WHERE NOT asks AND turn > 0 AND turn % 2 = 0),
schemas(tool, k, type, required) AS (VALUES {schemas}),
wrong AS (
  SELECT c.conv_id, c.call, CASE WHEN a.v IS NULL THEN CASE WHEN s.required THEN 'missing ' || s.k END
      WHEN NOT (CASE s.type WHEN 'string' THEN json_type(a.v) = 'VARCHAR' ELSE json_type(a.v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') END) AND (a.v->>'$."$ref"') IS NULL THEN 'not a ' || s.type || ' in ' || s.k END AS problem
  FROM c JOIN schemas s ON s.tool = c.name LEFT JOIN argument a ON a.conv_id = c.conv_id AND a.call = c.call AND a.k = s.k
  UNION ALL SELECT conv_id, call, 'unknown tool' FROM c WHERE name NOT IN (SELECT tool FROM schemas)),
problems AS (SELECT conv_id, call, list(problem ORDER BY problem) AS found FROM wrong WHERE problem IS NOT NULL GROUP BY ALL),
sorted AS (SELECT conv_id, call, '{' || coalesce(string_agg('"' || k || '":' || v::VARCHAR, ',' ORDER BY k), '') || '}' AS arguments FROM argument GROUP BY ALL),
linked AS (
  SELECT c.*, level, coalesce(arguments, '{}') AS arguments, content, coalesce(found, []) || CASE WHEN content IS NULL THEN ['no result'] ELSE [] END AS found
  FROM c JOIN levels USING (conv_id, call) LEFT JOIN sorted USING (conv_id, call) LEFT JOIN problems USING (conv_id, call) LEFT JOIN (SELECT conv_id, call, content FROM r) USING (conv_id, call)),
called AS (
  SELECT conv_id, turn, count(*) AS n_calls, count(*) FILTER (len(found) > 0) AS n_invalid,
         string_agg('{"arguments":' || arguments || ',"id":"' || call || '","name":"' || name || '","problems":[' || array_to_string(list_transform(found, lambda p: '"' || p || '"'), ',') || '],"result":' || coalesce(content, 'null') || '}', ',' ORDER BY level, place) AS calls,
         string_agg(chr(10) || '<tool_call>{"name": "' || name || '", "id": "' || call || '", "arguments": ' || given || '}</tool_call>', '' ORDER BY place) AS added
  FROM linked GROUP BY ALL),
answered AS (SELECT conv_id, turn, count(*) AS n_results, string_agg(chr(10) || '<tool_result>{"id": "' || call || '", "content": ' || raw || '}</tool_result>', '' ORDER BY call) AS added FROM r GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results, coalesce(n_invalid, 0)::BIGINT AS n_invalid,
       '{"content":' || to_json(body || coalesce(called.added, '') || coalesce(answered.added, ''))::VARCHAR || ',"conv_id":' || m.conv_id || ',"role":"' || m.role || '"'
       || coalesce(',"tool_calls":[' || calls || ']', '') || ',"turn":' || m.turn || '}' AS json
FROM m LEFT JOIN called ON called.conv_id = m.conv_id AND called.turn = m.turn LEFT JOIN answered ON answered.conv_id = m.conv_id AND answered.turn = m.turn
""".replace("{schemas}", ", ".join(f"('{tool}', '{k}', '{kind}', {required})" for tool, k, kind, required in SCHEMAS))
