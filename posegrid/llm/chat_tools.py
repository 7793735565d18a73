"""Tool-call linking in conversations, in DataFrame operations only.

Input are messages (conv_id, turn, role, text). A call message's text is a JSON object
``{"tool_calls": [{"id", "name", "arguments"}]}``; a result message has the role ``tool`` and the
text ``{"tool_call_id", "content"}``. Other messages are left alone.

1. Calls and results are read from the JSON and joined by a hash join on (conversation,
   identifier). Both are reduced to one row for each identifier before: the first call and the
   first result count, further ones are reported.
2. Arguments are validated against the tools' schemas: required, unknown and wrongly typed
   parameters; and references.
3. A call depends on the calls that its arguments name as ``${id}``. Calls sort topologically by
   (epoch, turn, place): epoch 0 is the order of the conversation, and only calls that a later
   call has to precede move to later epochs, round by round, until no edge is violated. A
   conversation's epochs can't exceed its backward references unless they form a cycle; calls
   that do are marked ``cyclic``; a call that names itself is so from the start. Only conversations
   with a backward reference take part; a round costs one join, and the rounds follow the longest chain
   of references there (for a cycle of several calls: its backward references). No conversation is
   gathered in a task.
4. Each call becomes a canonical JSON record: compact, keys sorted at every depth.

Defined results
  * null or unparsable text holds no call and no result; arguments that are no JSON object are
    invalid and serialised as null;
  * calls without an identifier can't be linked; they are reported as ``unnamed``;
  * repeated rows of a message are one message; results without a call are ``orphan`` rows;
  * a null conversation is a conversation of its own; empty tables give an empty result;
  * further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.llm._common import Scratch, bounded

CALLS = "tool_calls array<struct<id: string, name: string, arguments: string>>"
RESULT = "tool_call_id string, content string"


def canonical(json: Column) -> Column:
    """Compact JSON with sorted keys (a variant keeps its keys in order); null if it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, place, call_id, name, arguments): a row for each call."""
    read = F.from_json("text", CALLS)["tool_calls"]
    rows = messages.where("role <> 'tool' OR role IS NULL").where(F.col("text").contains("tool_calls"))
    rows = rows.select("conv_id", "turn", F.posexplode(read).alias("place", "c"))
    return rows.select("conv_id", "turn", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments")).distinct()


def results_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, content): a row for each result."""
    rows = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT).alias("r"))
    return rows.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")).where("call_id IS NOT NULL").distinct()


def violations(arguments: Column, params: Column) -> Column:
    """What is wrong with the arguments. ``params``: array of (name, type, required); null: unknown tool."""
    given = F.from_json(arguments, "map<string, variant>")
    kinds = F.transform_values(given, lambda k, v: F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Za-z]+", 0)))
    json = {"string": ["string"], "integer": ["bigint"], "number": ["bigint", "decimal", "double"], "boolean": ["boolean"], "array": ["array"], "object": ["object"]}
    names = F.transform(params, lambda p: p["name"])
    fits = lambda p: F.element_at(
        F.create_map(*[x for k, v in json.items() for x in (F.lit(k), F.array_contains(F.array(*map(F.lit, v)), F.element_at(kinds, p["name"])))]), p["type"]
    )
    say = lambda what, c: F.transform(c, lambda x: F.concat(F.lit(what + " "), x))
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.map_contains_key(given, p["name"])), lambda p: p["name"])
    wrong = F.transform(F.filter(params, lambda p: F.map_contains_key(given, p["name"]) & ~F.coalesce(fits(p), F.lit(False))), lambda p: p["name"])
    found = F.concat(say("missing", missing), say("mistyped", wrong), say("unknown", F.array_except(F.map_keys(given), names)))
    return (
        F.when(params.isNull(), F.array(F.lit("unknown tool")))
        .when(F.try_parse_json(arguments).isNull() | given.isNull(), F.array(F.lit("arguments are no object")))
        .otherwise(F.sort_array(found))
    )


def ordered(calls: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, call_id, epoch, cyclic) of the calls that leave epoch 0, and (conv, call_id, ref) of dangling references.

    ``calls``: first calls with an identifier.
    """
    nodes = calls.select(F.struct("conv_id").alias("conv"), "call_id", F.struct("turn", "place").alias("at"))
    refs = calls.select(
        F.struct("conv_id").alias("conv"), "call_id", F.struct("turn", "place").alias("at"),
        F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\$\{([^}]+)\}"), 1))).alias("ref"),
    )
    target = nodes.select("conv", F.col("call_id").alias("ref"), F.col("at").alias("ref_at"))
    edges = scratch.table(refs.join(target, ["conv", "ref"], "left"), "edges")
    dangling = edges.where("ref_at IS NULL").select("conv", "call_id", "ref")
    known = edges.where("ref_at IS NOT NULL").withColumn("back", (F.col("ref_at") >= F.col("at")).cast("int"))
    most = scratch.table(known.where("back = 1").groupBy("conv").agg(F.count("*").alias("most")), "backward")
    epochs = None
    if most.limit(1).count():
        # only conversations with a backward reference can move
        known = scratch.table(known.join(bounded(most), "conv").select("conv", "call_id", "ref", "back", "most"), "tangled")
        own = known.where("call_id = ref").select("conv", "call_id", (F.col("most") + 1).cast("int").alias("epoch"))
        epochs = scratch.table(own.distinct(), "epochs")
        while True:
            mine = known.join(epochs, ["conv", "call_id"], "left").withColumn("own", F.coalesce("epoch", F.lit(0))).drop("epoch")
            both = mine.join(epochs.select("conv", F.col("call_id").alias("ref"), "epoch"), ["conv", "ref"], "left")
            due = both.withColumn("due", F.coalesce("epoch", F.lit(0)) + F.col("back")).where("due > own AND own <= most")
            moved = scratch.table(due.groupBy("conv", "call_id").agg(F.max("due").cast("int").alias("epoch")), "moved")
            if not moved.limit(1).count():
                break
            epochs = scratch.table(epochs.unionByName(moved).groupBy("conv", "call_id").agg(F.max("epoch").alias("epoch")), "epochs")
        epochs = epochs.join(bounded(most), "conv").select("conv", "call_id", "epoch", (F.col("epoch") > F.col("most")).alias("cyclic"))
    else:
        epochs = known.select("conv", "call_id", F.lit(0).alias("epoch"), F.lit(False).alias("cyclic")).limit(0)
    return epochs, dangling


def link(messages: DataFrame, tools: DataFrame, scratch: Scratch) -> DataFrame:
    """Per call, and per result without one: how it is linked, whether it is valid, its place and its record.

    ``tools``: tool, params array<struct<name, type, required>>.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = scratch.table(calls_of(messages), "calls")
    results = scratch.table(results_of(messages), "results")
    one = calls.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "place", "name", "arguments")).alias("c"), F.count("*").alias("n_calls")
    )
    first = scratch.table(one.select("conv_id", "call_id", "c.*", "n_calls"), "first")
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answer = scratch.table(answer.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results"), "answers")
    key = lambda df: df.withColumn("conv", F.struct("conv_id")).drop("conv_id")  # noqa: E731  a struct joins nulls as equal
    linked = key(first).join(key(answer).hint("shuffle_hash"), ["conv", "call_id"], "full")
    tools = tools.select(F.col("tool").alias("name"), F.col("params"))
    linked = linked.join(bounded(tools), "name", "left")
    epochs, dangling = ordered(first, scratch)
    linked = linked.join(epochs, ["conv", "call_id"], "left")
    lost = dangling.groupBy("conv", "call_id").agg(F.sort_array(F.collect_set("ref")).alias("lost"))
    linked = linked.join(lost, ["conv", "call_id"], "left")
    wrong = F.concat(violations(F.col("arguments"), F.col("params")), F.transform(F.coalesce("lost", F.array().cast("array<string>")), lambda x: F.concat(F.lit("no call "), x)))
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    out = linked.select(
        "conv.conv_id", "turn", "place", "call_id", "name", status.alias("status"), "result_turn",
        F.coalesce("epoch", F.lit(0)).alias("epoch"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.when(F.col("n_calls").isNotNull(), wrong).otherwise(F.array().cast("array<string>")).alias("errors"),
        "arguments", "content",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
    )
    bare = calls.where("call_id IS NULL").join(bounded(tools), "name", "left").select(
        "conv_id", "turn", "place", "call_id", "name", F.lit("unnamed").alias("status"), F.lit(None).cast("long").alias("result_turn"), F.lit(0).alias("epoch"), F.lit(False).alias("cyclic"),
        violations(F.col("arguments"), F.col("params")).alias("errors"), "arguments", F.lit(None).cast("string").alias("content"),
        F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"),
    )
    out = out.unionByName(bare)
    valid = F.size("errors") == 0
    record = F.to_json(
        F.struct(  # in the order of the keys
            F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("call"), F.col("name").alias("name"),
            F.col("content").alias("result"), F.col("status").alias("status"),
        ),
        {"ignoreNullFields": "false"},
    )
    return out.select(
        "conv_id", "turn", "place", "call_id", "name", "status", "result_turn", "epoch", "cyclic",
        (valid & (F.col("n_calls") > 0)).alias("valid"), F.array_join("errors", "; ").alias("errors"), "n_calls", "n_results", record.alias("record"),
    )
