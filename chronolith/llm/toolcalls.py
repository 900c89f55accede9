"""Tool-call linking with DataFrame functions alone.

Calls and results of a conversation are joined by identifier, calls get their place in the order of their
dependencies, arguments are validated against schemas, and each call becomes one canonical JSON message: keys sorted,
no white space, equal numbers written equally and with all their digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed

#: Fields of a schema: its name, the kinds of a value that it takes, and whether it must be there.
FIELDS = "array<struct<field:string, kinds:array<string>, required:boolean>>"
#: Most calls of a conversation that one row may hold.
FOLDED = 2048
#: Characters that stand for a number, an escaped backslash and an escaped quote while a text is rewritten.
MARK, SLASH, QUOTE = "\ue000", "\ue010", "\ue011"
#: Digits up to which a number is written without an exponent.
PLAIN = 40


def schemas(spark, given: dict[str, dict[str, tuple[tuple[str, ...], bool]]]) -> DataFrame:
    """(tool, fields) from {tool: {field: (kinds, required)}}; kinds are string, number, boolean, object, array."""
    rows = [(tool, [(f, list(kinds), required) for f, (kinds, required) in fields.items()]) for tool, fields in given.items()]
    return spark.createDataFrame(rows, f"tool string, fields {FIELDS}")


def kind(value):
    """Kind of a variant: string, number, boolean, object, array or null."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "string")
        .when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "number")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def number(text):
    """The canonical form of a JSON number: no needless zero, no exponent up to PLAIN digits, else digits and exponent."""
    at = lambda group: F.regexp_extract(text, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", group)
    digits = F.regexp_replace(F.concat(at(2), at(3)), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    power = F.when(at(4) == "", F.lit(0)).otherwise(at(4).try_cast("long")) - F.length(at(3)) + F.length(digits) - F.length(short)
    size = F.length(short)
    form = (
        F.when((power >= 0) & (size + power <= PLAIN), F.concat(short, F.repeat(F.lit("0"), F.least(power, F.lit(PLAIN)).cast("int"))))
        .when((power < 0) & (size + power > 0), F.concat(F.substring(short, F.lit(1), (size + power).cast("int")), F.lit("."), F.substring(short, (size + power + 1).cast("int"), size)))
        .when((power < 0) & (-power <= PLAIN), F.concat(F.lit("0."), F.repeat(F.lit("0"), F.least(-power - size, F.lit(PLAIN)).cast("int")), short))
        .otherwise(F.concat(short, F.lit("e"), power.cast("string")))
    )
    return F.when(short == "", "0").otherwise(F.coalesce(F.concat(at(1), form), F.lower(text)))


def canonical(text, parsed):
    """Canonical JSON of a text that parses to the variant ``parsed``.

    The variant type sorts keys and drops white space, but writes 1e2 as 100.0 and cuts long numbers; so numbers go
    through it as marked strings in their canonical form. A text that holds MARK, SLASH or QUOTE itself keeps the
    variant's numbers.
    """
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit(SLASH)), F.lit('\\"'), F.lit(QUOTE))
    marked = lambda part: F.array_join(
        F.transform(
            F.regexp_extract_all(part, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^-0-9]+|-"), F.lit(0)),
            lambda t: F.when(t.rlike("[0-9]"), F.concat(F.lit(f'"{MARK}'), number(t), F.lit('"'))).otherwise(t),
        ),
        "",
    )
    parts = F.transform(F.split(plain, '"'), lambda part, i: F.when(i % 2 == 0, marked(part)).otherwise(part))
    whole = F.replace(F.replace(F.array_join(parts, '"'), F.lit(QUOTE), F.lit('\\"')), F.lit(SLASH), F.lit("\\\\"))
    exact = F.regexp_replace(F.to_json(F.try_parse_json(whole)), f'"{MARK}([^"]*)"', "$1")
    odd = text.rlike(r"[0-9][.eE]|[0-9]{18}|-0") & ~text.rlike(f"(?i)[{MARK}{SLASH}{QUOTE}]|\\\\ue000")
    return F.when(odd & parsed.isNotNull(), exact).otherwise(F.to_json(parsed))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for ``calls`` (conv_id, turn, call_id, after): calls without dependencies have level 0,
    the others one more than the highest they depend on; calls in or behind a cycle have no row. Dependencies that are
    no call of the conversation don't count.

    A conversation of at most FOLDED calls, each of which follows its dependencies by (turn, call_id), is settled in
    one row, by a fold over its calls. The others take rounds (see ``settled``).
    """
    few = calls.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") <= FOLDED).select("conv_id")
    rows = calls.join(few, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "call_id", "after"))).alias("own"))
    place = F.map_from_arrays(F.transform("own", lambda c: c["call_id"]), F.sequence(F.lit(0), F.size("own") - 1))
    rows = rows.withColumn("place", place)
    deps = F.transform("own", lambda c: F.filter(F.transform(F.array_distinct(c["after"]), lambda d: F.element_at("place", d)), lambda p: p.isNotNull()))
    rows = rows.withColumn("deps", deps)
    follows = F.forall(F.transform("deps", lambda d, i: F.coalesce(F.array_max(d), F.lit(-1)) < i), lambda x: x)
    fold = F.aggregate("deps", F.array().cast("array<int>"), lambda done, d: F.array_append(done, F.coalesce(F.array_max(F.transform(d, lambda p: F.get(done, p))) + 1, F.lit(0))))
    rows = rows.filter(follows).withColumn("levels", fold)
    pairs = F.transform("own", lambda c, i: F.struct(c["call_id"].alias("call_id"), F.get("levels", i).alias("level")))
    folded = checkpointed(rows.select("conv_id", F.inline(pairs)))
    rest = checkpointed(calls.join(folded.select("conv_id").distinct(), "conv_id", "left_anti"))
    if rest.isEmpty():
        return folded
    named = rest.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("dep"))
    known = rest.select("conv_id", F.col("call_id").alias("dep"))
    return folded.unionByName(settled(rest, named.join(known, ["conv_id", "dep"], "left_semi")))


def settled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """The levels of calls by rounds over all of them.

    ``edges`` (conv_id, call_id, dep) join calls that exist. Calls with one dependency first jump along their chains,
    twice as far in each round, to a call with none or several; then those with several are settled in the order of
    their depth among themselves. Chains of any length thus take a number of rounds that grows with its logarithm.
    """
    key = ["conv_id", "call_id"]
    edges = checkpointed(edges.select("conv_id", "call_id", "dep").distinct())
    n = edges.groupBy(*key).agg(F.count("*").alias("n"))
    single = edges.join(n.filter("n = 1"), key, "left_semi")
    several = edges.join(n.filter("n > 1"), key, "left_semi")
    roots = calls.select(*key).distinct().join(edges.select(*key), key, "left_anti").withColumn("level", F.lit(0).cast("long"))

    inner = single.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("inner"))
    state = single.join(inner, ["conv_id", "dep"], "left").select(
        *key, F.col("dep").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("inner").isNull().alias("done")
    )
    state, before = checkpointed(state), -1
    while (open_ := state.filter("not done").count()) not in (0, before):
        on = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("done").alias("end"))
        moved = state.filter("not done").join(on, ["conv_id", "to"]).select(*key, F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("done"))
        state, before = checkpointed(state.filter("done").unionByName(moved)), open_
    ends = state.filter("done").drop("done")

    # calls with several dependencies, each replaced by the end of its chain and the steps to it; cycles never settle
    known = ends.select("conv_id", F.col("call_id").alias("dep"), "to", "steps")
    chained = single.select("conv_id", F.col("call_id").alias("dep")).distinct().withColumn("chained", F.lit(True))
    waiting = several.join(known, ["conv_id", "dep"], "left").join(chained, ["conv_id", "dep"], "left")
    waiting = checkpointed(waiting.select(*key, F.when(F.col("chained") & F.col("to").isNull(), None).otherwise(F.coalesce("to", "dep")).alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
    settled, front, values = roots, roots, None
    while not waiting.isEmpty():
        met = front.select("conv_id", F.col("call_id").alias("to"), "level")
        hit = waiting.join(met, ["conv_id", "to"]).select(*key, (F.col("level") + F.col("steps")).alias("value"))
        values = checkpointed(hit if values is None else values.unionByName(hit))
        waiting = checkpointed(waiting.join(met, ["conv_id", "to"], "left_anti"))
        ready = values.join(waiting.select(*key), key, "left_anti")
        front = checkpointed(ready.groupBy(*key).agg(F.max("value").alias("level")))
        if front.isEmpty():
            break
        values = values.join(front.select(*key), key, "left_anti")
        settled = settled.unionByName(front)
    heads = settled.select("conv_id", F.col("call_id").alias("to"), "level")
    along = ends.join(heads, ["conv_id", "to"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return settled.unionByName(along).withColumn("level", F.col("level").cast("int"))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each (conv_id, call_id): conv_id, call_id, turn, level, copies, n_results, valid, errors, message.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after (array of call ids, may be null).
    ``results``: conv_id, turn, call_id, content. ``tools``: see ``schemas``.

    Repeated calls count as copies of the first by (turn, name, arguments); of repeated results the first by (turn,
    content) is linked, and n_results counts all. Results without a call have no row here (``orphans`` lists them).
    A null conv_id, call id or both identify like any value. Errors, in this order: unknown_tool, not_json (null or
    malformed text, or repeated keys), not_an_object, missing:FIELD, kind:FIELD, unknown:FIELD, unknown_call:ID for a
    dependency that is no call of the conversation, cycle (its level is null). The message has arguments (canonical,
    or null), depends_on, id, name and result; order by level, turn and call_id for a topological order.
    """
    mark = F.lit("\x00null")
    keyed = lambda df: df.withColumns({"conv_key": F.coalesce(F.col("conv_id").cast("string"), mark), "call_key": F.coalesce("call_id", mark)})
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("first")
    own = keyed(calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after")))
    own = own.groupBy("conv_key", "call_key").agg(F.first("conv_id").alias("conv_id"), F.first("call_id").alias("call_id"), first, F.count("*").alias("copies"))
    own = own.select("conv_key", "call_key", "conv_id", "call_id", "first.*", "copies")
    got = keyed(results.select("conv_id", "turn", "call_id", "content")).groupBy("conv_key", "call_key")
    got = got.agg(F.min(F.struct("turn", "content"))["content"].alias("result"), F.count("*").alias("n_results"))
    linked = own.join(got, ["conv_key", "call_key"], "left")

    keys = checkpointed(own.select("conv_key", "turn", "call_key", "after"))
    named = keys.select(F.col("conv_key").alias("conv_id"), F.col("call_key").alias("call_id"), F.explode(F.array_distinct("after")).alias("dep"))
    known = keys.select(F.col("conv_key").alias("conv_id"), F.col("call_key").alias("dep"))
    stray = named.join(known, ["conv_id", "dep"], "left_anti")
    placed = levels(keys.select(F.col("conv_key").alias("conv_id"), "turn", F.col("call_key").alias("call_id"), "after"))
    strays = stray.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("unknown_call:"), "dep"))).alias("strays"))
    for side in (placed, strays):
        linked = linked.join(side.withColumnsRenamed({"conv_id": "conv_key", "call_id": "call_key"}), ["conv_key", "call_key"], "left")

    linked = linked.join(tools.select(F.col("tool").alias("name"), "fields"), "name", "left")
    linked = linked.withColumn("parsed", F.try_parse_json("arguments"))
    linked = linked.withColumn("shape", F.when(F.col("parsed").isNotNull(), kind(F.col("parsed"))))
    values = F.when(F.col("shape") == "object", F.col("parsed").cast("map<string,variant>"))
    kinds = F.transform_values(values, lambda _, v: kind(v))
    linked = linked.withColumn("kinds", F.coalesce(kinds, F.create_map().cast("map<string,string>")))
    no = F.array().cast("array<string>")
    one = lambda condition, text: F.when(condition, F.array(F.lit(text))).otherwise(no)
    at = lambda f: F.element_at("kinds", f["field"])
    tag = lambda text, part: F.transform(part, lambda f: F.concat(F.lit(text), f["field"]))
    checked = F.when(
        (F.col("shape") == "object") & F.col("fields").isNotNull(),
        F.concat(
            tag("missing:", F.filter("fields", lambda f: f["required"] & at(f).isNull())),
            tag("kind:", F.filter("fields", lambda f: at(f).isNotNull() & ~F.array_contains(f["kinds"], at(f)))),
            F.transform(
                F.array_sort(F.array_except(F.map_keys("kinds"), F.transform("fields", lambda f: f["field"]))),
                lambda k: F.concat(F.lit("unknown:"), k),
            ),
        ),
    ).otherwise(no)
    errors = F.concat(
        one(F.col("fields").isNull(), "unknown_tool"),
        one(F.col("shape").isNull(), "not_json"),
        one(F.col("shape") != "object", "not_an_object"),
        checked,
        F.coalesce("strays", no),
        one(F.col("level").isNull(), "cycle"),
    )
    arguments = F.coalesce(canonical(F.col("arguments"), F.col("parsed")), F.lit("null"))
    bare = lambda column: F.when(F.col(column).isNull(), "null").otherwise(F.expr(f"substr(to_json(array({column})), 2, length(to_json(array({column}))) - 2)"))
    message = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"depends_on":'), F.to_json(F.array_sort(F.array_distinct("after"))),
        F.lit(',"id":'), bare("call_id"), F.lit(',"name":'), bare("name"), F.lit(',"result":'), bare("result"), F.lit("}"),
    )
    return linked.select(
        "conv_id", "call_id", "turn", "level", "copies", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        (F.size(errors) == 0).alias("valid"), F.array_join(errors, ",").alias("errors"), message.alias("message"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results (conv_id, turn, call_id, content) whose identifier is no call's of the same conversation."""
    own = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).distinct()
    r = results.select("conv_id", "turn", "call_id", "content")
    return r.join(own, r.conv_id.eqNullSafe(own.c) & r.call_id.eqNullSafe(own.i), "left_anti")


TOOLS = {
    "ask": {"query": (("string",), True), "turn": (("number",), True)},
    "open": {"query": (("string",), True), "turn": (("number",), True), "limit": (("number",), False)},
}


def of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns: a user's turn calls a tool, the assistant's next turn is its result.

    The first turn opens (tool ``open``), later ones ask; each depends on the user's turn two before. Null texts leave
    the query out of the arguments; repeated turns are copies of a call.
    """
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    turns = turns.select("conv_id", "turn", "role", "text")
    calls = turns.filter("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"),
        F.when(F.col("turn") <= 1, "open").otherwise("ask").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("query"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).alias("after"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op5_toolcalls(spark, sf_dir) -> DataFrame:
    """Every user's turn as a call, linked to the assistant's turn behind it."""
    from chronolith.llm.common import table

    calls, results = of_conversations(table(spark, sf_dir, "conversations"))
    return link(calls, results, schemas(spark, TOOLS))


OP5_SQL = """
WITH u AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, min(text) AS text, 'c' || conv_id || '-' || turn AS call_id FROM u GROUP BY conv_id, turn),
n AS (SELECT conv_id, turn, count(*) AS copies FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
i AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM i),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result, count(*) AS n_results
      FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
e AS (
  SELECT l.conv_id, l.call_id, l.turn, l.level, n.copies, coalesce(r.n_results, 0) AS n_results, r.result, l.text,
         concat_ws(',', CASE WHEN l.text IS NULL THEN 'missing:query' END,
                   CASE WHEN l.turn >= 2 AND l.level = 0 THEN 'unknown_call:c' || l.conv_id || '-' || (l.turn - 2) END) AS errors
  FROM l JOIN n USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn))
SELECT conv_id, call_id, turn, CAST(level AS INTEGER) AS level, copies, n_results, errors = '' AS valid, errors,
       '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"query":' || to_json(text) || ',' END || '"turn":' || turn
       || '},"depends_on":' || CASE WHEN turn >= 2 THEN '["c' || conv_id || '-' || (turn - 2) || '"]' ELSE '[]' END
       || ',"id":"' || call_id || '","name":"' || CASE WHEN turn <= 1 THEN 'open' ELSE 'ask' END || '","result":'
       || CASE WHEN result IS NULL THEN 'null' ELSE to_json(result) END || '}' AS message
FROM e
"""
