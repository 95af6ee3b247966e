"""Chat formatting: linking tool calls to their results, in DataFrame operations.

Calls and results meet in a hash join by conversation and identifier. Calls are ordered topologically: level 0 refers to no
other call of its conversation, level k + 1 to calls of level k at most. A call's level is a longest path; paths are put together
over blocks of turns that double in size, so the number of rounds is the logarithm of the longest conversation, however deep
calls refer and to however many. References to a call of the same or a later turn can't be cut so; what they point to is
settled in rounds, as many as a path has of them. Arguments are validated against the tools' schemas. Each call becomes one line of
canonical JSON: keys in order at every depth, no spaces.

Defined results: a call id without a result is ``no_result``, a result without a call ``orphan``; of several results of an
id the first by turn (then content) counts, and n_results tells how many there are; repeated calls each get the result,
and id_repeated is true; calls in or after a cycle have no level; null or broken arguments are ``not JSON``; null ids
link with nothing; turns of a system, or of no known role, are ``context``; a very long text is in its lines whole; empty
tables give empty results; extra columns are not read. A conversation is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable

#: Tool -> parameter -> (type, required). Types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, as an array of strings in the order of the schema; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        found = []
        for p, (kind, required) in parameters.items():
            value = F.schema_of_variant(F.variant_get(parsed, f"$.{p}", "variant"))
            there = F.array_contains(keys, p)
            found.append(F.when(~there, F.lit(f"{p}: missing") if required else F.lit(None)).when(~value.rlike(f"^{_KINDS[kind]}$"), F.lit(f"{p}: not {kind}")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]))), lambda k: F.concat(k, F.lit(": unexpected")))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), extra)).otherwise(out)
    return F.when(parsed.isNull(), F.array(F.lit("not JSON"))).when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(out)


#: Rounds over forward references between two written tables.
UNROLLED = 3


def _substituted(terms: DataFrame) -> DataFrame:
    """``terms`` (conv_id, call_id, pos, up, up_pos, far, steps) with every earlier call put in the place of its own terms, so that
    up is null, the start of all chains, or far, a reference that points forward.

    A conversation is cut into blocks of 2, 4, 8, ... turns. When blocks of a size are done, no term of a call lies in the
    call's block; at the next size one join puts the terms of the first half's calls into those of the second half. So a level takes
    one join, and a call has at most as many terms as different calls before its block are referred to from it."""
    joint = F.when(F.col("up").isNotNull() & ~F.col("far"), F.length(F.bin(F.col("pos").bitwiseXOR(F.col("up_pos")))))
    terms = durable(terms.withColumn("joint", joint), "terms")
    while (size := terms.agg(F.min("joint")).collect()[0][0]) is not None:
        hit = F.coalesce(F.col("joint") == size, F.lit(False))
        own = terms.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("up_pos").alias("next_pos"), F.col("far").alias("next_far"), F.col("steps").alias("more"))
        put = terms.where(hit).join(own.hint("shuffle_hash"), ["conv_id", "up"]).select("conv_id", "call_id", "pos", F.col("next").alias("up"), F.col("next_pos").alias("up_pos"), F.col("next_far").alias("far"), (F.col("steps") + F.col("more")).alias("steps"))
        new = terms.where(~hit).drop("joint").unionByName(put).groupBy("conv_id", "call_id", "pos", "up", "up_pos", "far").agg(F.max("steps").alias("steps"))
        last, terms = terms, durable(new.withColumn("joint", joint), "terms")
        discard(last)
    return terms


def call_levels(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that have one. calls: (conv_id, call_id) and, if there is one, turn, the order in which
    calls were made; refs: (conv_id, call_id, ref), a call and one it refers to."""
    ids = ["conv_id", "call_id"]
    pos = F.min(F.col("turn").cast("long")) if "turn" in calls.columns else F.lit(0).cast("long")
    nodes = calls.where("conv_id is not null and call_id is not null").groupBy(*ids).agg(pos.alias("pos"))
    known = nodes.select("conv_id", F.col("call_id").alias("ref"), F.col("pos").alias("up_pos"))
    links = refs.select(*ids, "ref").distinct().join(known, ["conv_id", "ref"]).join(nodes, ids)
    far = F.coalesce(F.col("up_pos") >= F.col("pos"), F.lit(True))
    links = durable(links.select(*ids, "pos", F.col("ref").alias("up"), "up_pos", far.alias("far"), F.lit(1).alias("steps")), "refs")
    start = nodes.join(links, ids, "left_anti").select(*ids, "pos", F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("up_pos"), F.lit(False).alias("far"), F.lit(0).alias("steps"))
    terms = _substituted(links.unionByName(start))
    discard(links)
    targets = terms.where("far").select("conv_id", F.col("up").alias("call_id")).distinct()
    if targets.limit(1).count() == 0:
        return terms.groupBy(*ids).agg(F.max("steps").alias("level"))
    # What forward references point to is settled in rounds; calls in or after a cycle never are.
    edges = durable(terms.join(targets, ids, "left_semi").select(*ids, "up", "steps"), "edges")
    settled = durable(targets.withColumn("level", F.lit(None).cast("int")), "settled")

    def levels(of: DataFrame, known: DataFrame) -> DataFrame:
        known = known.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("up_level"))
        here = F.when(F.col("up").isNull(), F.col("steps")).otherwise(F.col("steps") + F.col("up_level"))
        return of.join(known.hint("shuffle_hash"), ["conv_id", "up"], "left").groupBy(*ids).agg(F.when(F.count("*") == F.count(here), F.max(here)).cast("int").alias("level"))

    before = 0
    while True:
        last, settled = settled, levels(edges, settled)
        for _ in range(UNROLLED - 1):
            settled = levels(edges, settled)
        settled = durable(settled, "settled")
        discard(last)
        done = settled.where("level is not null").count()
        if done == before:
            break
        before = done
    discard(edges)
    return levels(terms, settled).where("level is not null")


def link_tool_calls(calls: DataFrame, results: DataFrame, refs: DataFrame, schemas: Schemas, context: DataFrame | None = None) -> DataFrame:
    """calls: (conv_id, turn, call_id, name, arguments); results: (conv_id, turn, call_id, content); context: (conv_id, turn, role,
    content), turns that are neither.

    Returns a row for each call, for each id of results without a call, and for each turn of context: conv_id, turn, call_id, name,
    level, status (linked, no_result, orphan, context), valid, errors, n_results, id_repeated, line."""
    ids = ["conv_id", "call_id"]
    answer = results.groupBy(*ids).agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    times = calls.groupBy(*ids).agg((F.count("*") > 1).alias("id_repeated"))
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    linked = calls.join(times.hint("shuffle_hash"), ids, "left").join(answer.hint("shuffle_hash"), ids, "left").join(call_levels(calls, refs).hint("shuffle_hash"), ids, "left").withColumn("errors", errors)
    line = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.struct(F.col("answer.content").alias("content"), F.col("answer.turn").alias("turn")).alias("result")))
    rows = linked.select(
        "conv_id", "turn", "call_id", "name", "level", F.when(F.col("n_results").isNull(), "no_result").otherwise("linked").alias("status"), (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.coalesce("id_repeated", F.lit(False)).alias("id_repeated"), line.alias("line"),
    )
    lone = answer.join(calls.select(*ids).distinct(), ids, "left_anti").select(
        "conv_id", F.col("answer.turn").alias("turn"), "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"), F.lit(False).alias("valid"), F.lit("no call").alias("errors"),
        "n_results", F.lit(False).alias("id_repeated"), F.to_json(F.struct(F.col("call_id").alias("id"), F.struct(F.col("answer.content").alias("content"), F.col("answer.turn").alias("turn")).alias("result"))).alias("line"),
    )
    out = rows.unionByName(lone)
    if context is not None:
        said = F.to_json(F.struct("content", "role"))
        out = out.unionByName(context.select("conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit("context").alias("status"), F.lit(True).alias("valid"), F.lit("").alias("errors"), F.lit(0).cast("long").alias("n_results"), F.lit(False).alias("id_repeated"), said.alias("line")))
    return out


#: The tools that the query over ``conversations`` assumes.
TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True), "after": ("string", False)},
    "summarise": {"text": ("string", True), "words": ("integer", True), "after": ("string", False)},
}


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, results, references and context from the turns (conv_id, turn, role, text) of conversations.

    An assistant's turn that is a JSON object with id and name is that call, and refers to its argument ``after``; any other turn
    of a user or a tool that is a JSON object with call_id and content is that result. Plain turns become calls and
    results, too: an assistant's is a call with the identifier of its turn, with its whole text in the arguments; every fifth
    names no known tool, and searches for short texts lack the limit. It refers to the assistant's two calls before it. A
    user's turn answers the turn before it."""
    text = F.coalesce("text", F.lit(""))
    json = F.when(text.rlike(r"^\s*\{") & F.is_valid_utf8(text) & F.try_parse_json(text).isNotNull(), text)
    turns = conversations.select("conv_id", "turn", "role", text.alias("text"), json.alias("json"))
    of = lambda key: F.get_json_object("json", f"$.{key}")
    text, own = F.col("text"), of("id").isNotNull() & of("name").isNotNull()
    call_id = F.concat(F.lit("call_"), F.col("turn"))
    before = lambda n: F.when(F.col("turn") > n, F.concat(F.lit("call_"), F.col("turn") - n))
    name = F.when(F.length(text) % 5 == 0, "unknown").when(F.length(text) % 2 == 0, "search").otherwise("summarise")
    search = F.to_json(F.struct(text.alias("query"), F.when(F.length(text) >= 60, F.length(text) % 50).alias("limit"), before(2).alias("after")))
    summarise = F.to_json(F.struct(F.regexp_count(text, F.lit(r"\S+")).alias("words"), text.alias("text"), before(2).alias("after")))
    said = turns.where("role = 'assistant'").withColumn("own", F.coalesce(own, F.lit(False)))
    plain = said.where("not own")
    given = said.where("own").select("conv_id", "turn", of("id").alias("call_id"), of("name").alias("name"), of("arguments").alias("arguments"))
    calls = plain.select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), F.when(name == "summarise", summarise).otherwise(search).alias("arguments")).unionByName(given)
    refs = plain.select("conv_id", call_id.alias("call_id"), F.explode(F.array_compact(F.array(before(2), before(4)))).alias("ref"))
    refs = refs.unionByName(given.select("conv_id", "call_id", F.get_json_object("arguments", "$.after").alias("ref")).where("ref is not null"))
    is_result = of("call_id").isNotNull() & of("content").isNotNull()
    answers = turns.where("role in ('user', 'tool')")
    results = answers.select("conv_id", "turn", F.when(is_result, of("call_id")).otherwise(F.concat(F.lit("call_"), F.col("turn") - 1)).alias("call_id"), F.when(is_result, of("content")).otherwise(text).alias("content"))
    rest = turns.where(~F.coalesce(F.col("role").isin("assistant", "user", "tool"), F.lit(False)))
    return calls, results, refs, rest.select("conv_id", "turn", "role", text.alias("content"))
