"""Chat formatting with tool calls: link calls to results, order them, check their arguments, write canonical JSON.

Calls and results are joined on hash partitions of conversation, identifier and occurrence: the occurrences of repeated
identifiers are numbered by turn on each side, so that they neither multiply nor get lost. Calls may name others that must
come before them. Chains in which each call has one before it are followed by pointer doubling, so a chain of a thousand
calls takes ten rounds; what is left, calls with several before them, is freed round by round, all conversations at once.
Calls on or behind a cycle get no depth. Arguments are parsed once and checked against the schema of the named tool. The
result has a row per message and call, numbered within its conversation in topological order, each with its canonical
JSON: keys sorted, no blanks. A conversation of any length is never gathered into one row or window: equal rows are
counted first, and numbers come from the counts of blocks of turns and of cells of each turn.

Null texts are left out of the JSON. Repeated identifiers: the k-th call meets the k-th result, and what is left over on a
side stays as a row. Rows of a null conversation or identifier stay, but are never linked. Equal turns stand in the order
of their kind, depth, checksum and text. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwise.llm.common import stored

#: Tool -> field -> (type, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]
#: What schema_of_variant tells for each type.
_TELLS = {
    "string": r"STRING", "integer": r"BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL\(.*\)", "boolean": r"BOOLEAN",
    "array": r"ARRAY<.*>", "object": r"OBJECT<.*>",
}
BLOCK = 1024
#: Cells of the rows of one turn, kind and depth, by the first digits of their checksum.
DIGITS = 2

#: What names a call.
CALL = ["conv_id", "call_id", "occurrence"]

#: Tools of the calls that the query derives.
SCHEMAS: Schemas = {
    "lookup": {"query": ("string", True), "limit": ("integer", True), "exact": ("boolean", False)},
    "measure": {"chars": ("integer", True), "unit": ("string", True)},
    "remind": {"minutes": ("number", True), "note": ("string", True)},
}


def _errors(schemas: Schemas) -> Column:
    """Faults of ``arguments`` and its variant ``parsed`` against the schema of ``name``, in the schemas' order."""

    def of_field(field: str, kind: str, required: bool) -> Column:
        found = F.schema_of_variant(F.try_variant_get("parsed", f"$.{field}", "variant"))
        absent = F.lit(f"missing {field}") if required else F.lit(None).cast("string")
        return F.when(found.isNull() | (found == "VOID"), absent).when(
            ~found.rlike(f"^({_TELLS[kind]})$"), F.lit(f"{field} is not {kind}")
        )

    def of_tool(fields: dict[str, tuple[str, bool]]) -> Column:
        known = F.array(*map(F.lit, fields))
        extra = F.transform(
            F.array_sort(F.array_except(F.json_object_keys("arguments"), known)), lambda x: F.concat(F.lit("unknown "), x)
        )
        return F.concat(F.array(*(of_field(f, *spec) for f, spec in fields.items())), F.coalesce(extra, F.array()))

    faults = F.when(F.col("parsed").isNull(), F.array(F.lit("not JSON")))
    faults = faults.when(~F.schema_of_variant("parsed").startswith("OBJECT"), F.array(F.lit("not an object")))
    faults = reduce(lambda c, tool: c.when(F.col("name") == tool, of_tool(schemas[tool])), schemas, faults)
    return F.array_compact(faults.otherwise(F.array(F.lit("unknown tool"))))


def _occurrences(rows: DataFrame, *order: str) -> DataFrame:
    """``occurrence`` from 1 of each row among those of its identifier, by turn; no window holds more than a block of turns."""
    key = ["conv_id", "call_id"]
    blocked = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    counts = blocked.groupBy(*key, "block").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("conv_id").alias("of_conv"), F.col("call_id").alias("of_call"), F.col("block").alias("of_block"), start)
    inside = Window.partitionBy(*key, "block").orderBy(*order)
    nth = blocked.withColumn("nth", F.row_number().over(inside))
    same = (
        (F.col("conv_id") == F.col("of_conv")) & (F.col("call_id") == F.col("of_call"))
        & F.col("block").eqNullSafe(F.col("of_block"))
    )
    return nth.join(starts, same).select(*rows.columns, (F.col("start") + F.col("nth")).alias("occurrence"))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results, and results without a call: ``status`` is linked, no result or no call.

    The k-th call of an identifier is linked to its k-th result; ``occurrence`` tells k.
    """
    key = ["conv_id", "call_id"]
    calls, results = calls.select(*key, "turn", "name", "arguments", "after"), results.select(*key, "turn", "content")
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    loose = F.lit(None).cast("long").alias("occurrence")
    loose_calls = calls.where(~known).select(
        *key, loose, "name", "arguments", "after", "turn", F.lit(None).cast("string").alias("content"),
        F.lit("no result").alias("status"),
    )
    none = [F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in ("name", "arguments", "after")]
    loose_results = results.where(~known).select(*key, loose, *none, "turn", "content", F.lit("no call").alias("status"))
    each_call = _occurrences(calls.where(known), "turn", "name", "arguments", "after").select(
        *key, "occurrence", F.struct("turn", "name", "arguments", "after").alias("c")
    )
    each_result = _occurrences(results.where(known), "turn", "content").select(
        *key, "occurrence", F.struct("turn", "content").alias("r")
    )
    status = F.when(F.col("c").isNull(), "no call").when(F.col("r").isNull(), "no result").otherwise("linked")
    met = each_call.join(each_result, [*key, "occurrence"], "full").select(
        *key, "occurrence", "c.name", "c.arguments", "c.after", F.coalesce("c.turn", "r.turn").alias("turn"), "r.content",
        status.alias("status"),
    )
    return met.unionByName(loose_calls).unionByName(loose_results)


def _edges(calls: DataFrame) -> DataFrame:
    """``node, pred``: each call with each call that it names, both by conversation, identifier and occurrence."""
    counts = calls.groupBy("conv_id", F.col("call_id").alias("before")).agg(F.count("*").alias("n"))
    again = (F.col("before") == F.col("call_id")) & (F.col("occurrence") > 1)
    of = F.when(again, F.col("occurrence") - 1).otherwise(F.least("occurrence", "n"))
    named = calls.select(*CALL, F.explode("after").alias("before")).distinct().join(counts, ["conv_id", "before"])
    pred = F.struct(F.col("conv_id"), F.col("before").alias("call_id"), of.alias("occurrence"))
    return named.select(F.struct(*CALL).alias("node"), pred.alias("pred"))


def _chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, up, dist, latest`` of the calls with just one before them: the first call up their chain that has none or
    several, how many steps away, and the last turn on the way. Chains that end in a cycle are left out.

    Each round doubles the length of the pointers; the longest chain a conversation can hold bounds the rounds.
    """
    lone = edges.groupBy("node").agg(F.count("*").alias("n"), F.first("pred").alias("up")).where("n = 1").select("node", "up")
    now = stored(lone.join(nodes, "node").select("node", "up", F.lit(1).cast("long").alias("dist"), F.col("turn").alias("latest")))
    longest = now.groupBy("node.conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(int(longest).bit_length()):
        ahead = now.select(
            F.col("node").alias("at_node"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("latest").alias("then")
        )
        moved = stored(now.join(ahead, F.col("up") == F.col("at_node"), "left").select(
            "node", F.coalesce("next", "up").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
            F.greatest("latest", "then").alias("latest"), F.col("next").isNotNull().alias("moved"),
        ))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now
    return now.join(now.select(F.col("node").alias("up")), "up", "left_anti").select("node", "up", "dist", "latest")


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, occurrence, depth, at``: the longest chain of calls before each, and the turn it can come at.

    That is its own turn, or a later one if a call that must come before it has a later one. Calls on or behind a cycle
    are left out. Names that no call has are ignored. Of a repeated identifier the k-th call is meant by the k-th call that
    names it, or the last if there are fewer, and the call before by one that names its own.
    """
    nodes = calls.select(F.struct(*CALL).alias("node"), "turn")
    edges = stored(_edges(calls))
    chains = stored(_chains(edges, nodes))
    several = edges.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    of_pred = chains.select(F.col("node").alias("pred"), "up", "dist", "latest")
    # a call that is lone but in no chain hangs on a cycle; it is never found, and what names it waits for ever
    waiting = stored(edges.join(several, "node", "left_semi").join(of_pred, "pred", "left").select(
        "node", F.coalesce("up", "pred").alias("root"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"), "latest"
    ))
    every = waiting
    front = stored(
        nodes.join(edges, "node", "left_anti").select("node", F.lit(0).cast("long").alias("depth"), F.col("turn").alias("at"))
    )
    found = front
    while not waiting.isEmpty() and not front.isEmpty():
        left = stored(waiting.join(front.select(F.col("node").alias("root")), "root", "left_anti"))
        free = waiting.select("node").distinct().join(left.select("node").distinct(), "node", "left_anti")
        roots = found.select(F.col("node").alias("root"), "depth", "at")
        freed = every.join(free, "node", "left_semi").join(roots, "root").groupBy("node").agg(
            F.max(F.col("depth") + F.col("dist")).alias("depth"), F.max(F.greatest("at", "latest")).alias("at")
        )
        front = stored(freed.join(nodes, "node").select("node", "depth", F.greatest("at", "turn").alias("at")))
        found, waiting = found.unionByName(front), left
    ends = found.select(F.col("node").alias("up"), "depth", "at")
    along = chains.join(ends, "up").select(
        "node", (F.col("depth") + F.col("dist")).alias("depth"), F.greatest("at", "latest").alias("at")
    )
    return found.unionByName(along).select("node.*", F.col("depth").cast("int").alias("depth"), "at")


def _numbered(rows: DataFrame) -> DataFrame:
    """``position`` from 0 within each conversation.

    Equal rows are counted before they move. A window over a conversation sees a row per block of turns, one over a block
    a row per cell, and one over a cell the different rows of one turn, kind, depth and first digits of the checksum.
    """
    conv, block, cell = ["conv_id"], ["conv_id", "block"], ["conv_id", "block", "at", "kind", "depth", "digits"]
    distinct = (
        rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
        .withColumns({"block": F.floor(F.col("at") / BLOCK), "digits": F.substring(F.md5("json"), 1, DIGITS)})
    )
    cells = distinct.groupBy(*cell).agg(F.sum("copies").alias("n"))

    def before(keys: list[str], *order: Column, n: str = "n") -> Column:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(window), F.lit(0))

    def with_start(df: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
        renamed = starts.select(*(F.col(k).alias(f"of_{k}") for k in keys), "start")
        return df.join(renamed, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]).drop(*(f"of_{k}" for k in keys))

    of_block = cells.groupBy(*block).agg(F.sum("n").alias("n")).withColumn("start", before(conv, F.asc_nulls_last("block")))
    order = [F.col("at"), F.col("kind"), F.asc_nulls_last("depth"), F.col("digits")]
    of_cell = with_start(cells.withColumn("inner", before(block, *order)), of_block, block).select(
        *cell, (F.col("start") + F.col("inner")).alias("start")
    )
    inside = before(cell, F.md5("json"), F.col("json"), F.col("turn"), F.col("call_id"), F.col("occurrence"), n="copies")
    placed = with_start(distinct.withColumn("inner", inside), of_cell, cell)
    first = F.col("start") + F.col("inner")
    return placed.withColumn("position", F.explode(F.sequence(first, first + F.col("copies") - 1)))


def formatted(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """A row per message, call and stray result.

    ``conv_id, position, turn, kind, call_id, occurrence, depth, status, errors, json``.

    ``messages(conv_id, turn, role, text)``, ``calls(conv_id, turn, call_id, name, arguments, after)``,
    ``results(conv_id, turn, call_id, content)``.
    """
    links = stored(linked(calls, results))
    made = links.where("status <> 'no call' and conv_id is not null and call_id is not null")
    parsed = links.join(depths(made), ["conv_id", "call_id", "occurrence"], "left").withColumn("parsed", F.try_parse_json("arguments"))
    is_call = F.col("status") != "no call"
    arguments = F.coalesce(F.to_json(F.struct(F.col("parsed").alias("arguments"))), F.lit("{}"))
    rest = F.to_json(F.struct(F.col("call_id").alias("call"), "name", F.col("content").alias("result")))
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    joined = F.concat_ws(",", F.nullif(inner("head"), F.lit("")), inner("tail"))
    errors = F.when(is_call, F.array_join(_errors(schemas), "; "))
    tools = parsed.withColumns({"head": arguments, "tail": rest}).select(
        "conv_id", "turn", F.coalesce("at", "turn").alias("at"), F.when(is_call, 1).otherwise(2).alias("kind"), "call_id",
        "occurrence", "depth", "status", errors.alias("errors"), F.concat(F.lit("{"), joined, F.lit("}")).alias("json"),
    )
    none = F.lit(None).cast("string")
    said = messages.select(
        "conv_id", "turn", F.col("turn").alias("at"), F.lit(0).alias("kind"), none.alias("call_id"),
        none.cast("long").alias("occurrence"), none.cast("int").alias("depth"), none.alias("status"), none.alias("errors"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    names = F.element_at(F.array(F.lit("message"), F.lit("call"), F.lit("result")), F.col("kind") + 1)
    return _numbered(said.unionByName(tools)).select(
        "conv_id", "position", "turn", names.alias("kind"), "call_id", "occurrence", "depth", "status", "errors", "json"
    )


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations.

    Every assistant's turn makes a call whose tool, identifier, arguments and predecessors follow from its text's length
    and checksum. The whole text is an argument. Some arguments are at odds with the schema, some identifiers are shared by
    calls of one conversation, and calls come after earlier and later ones, after missing ones, after calls of a shared
    identifier, or after themselves, so that there are cycles. The next turn answers a call.
    """
    text = F.coalesce("text", F.lit(""))
    length, mark = F.char_length(text), F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")
    tool = F.element_at(F.array(*map(F.lit, [*SCHEMAS, "dance"])), (length % 4 + 1).cast("int"))
    limit = F.when(length % 5 == 0, F.lit('"all"')).otherwise(length.cast("string"))
    quoted = F.expr("substring(to_json(array(whole)), 2, length(to_json(array(whole))) - 2)")
    query = F.concat(F.lit('{ "query": '), F.col("quoted"))
    arguments = (
        F.when(length % 7 == 0, query)  # not closed
        .when(tool == "lookup", F.concat(query, F.lit(', "limit" : '), limit, F.lit("}")))
        .when(tool == "measure", F.concat(F.lit('{"unit":"m", "chars": '), length.cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"note":'), F.col("quoted"), F.lit(', "minutes": 5, "loud": true}')))
    )

    def named(part: Column) -> Column:
        return F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), part.cast("string"))

    turn, mark_ = F.col("turn"), F.col("mark")
    after = F.array_compact(F.array(
        F.when(F.floor(turn / 2) != turn, named(F.floor(turn / 2))), F.when(mark_ % 3 == 0, named(turn + 2)),
        F.when(mark_ % 4 == 1, named(F.lit("s"))), F.when(mark_ % 11 == 0, named(turn)),
    ))
    turns = conversations.select("conv_id", "turn", "role", "text").where("role = 'assistant'")
    calls = turns.withColumns({"whole": text, "mark": mark}).withColumn("quoted", quoted).select(
        "conv_id", "turn", F.when(mark_ % 5 == 0, named(F.lit("s"))).otherwise(named(turn)).alias("call_id"),
        tool.alias("name"), arguments.alias("arguments"), after.alias("after"),
    )
    asked = calls.groupBy("conv_id", (turn + 1).alias("turn")).agg(F.min("call_id").alias("call_id"))
    answers = conversations.where("role = 'user' and turn > 0").select("conv_id", "turn", F.col("text").alias("content"))
    results = answers.join(asked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("call_id", named(turn - 1)).alias("call_id"), "content"
    )
    return calls, results


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    calls, results = derived_calls(conversations)
    return formatted(conversations.select("conv_id", "turn", "role", "text"), calls, results, SCHEMAS)
