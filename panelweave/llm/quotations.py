"""Chat formatting by quotation linking, in DataFrame functions only.

Lines with quote marks (">", nested ">>" or "> >") are parsed into passages by level. A quoted passage,
normalised and hashed, is joined to the latest earlier message of its conversation that says the same
without marks, as a whole passage or, failing that, line by line. The message behind the outermost quote is
what a message replies to. Replies make threads; messages are returned in thread order with quotes taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.tables import drop_staged, stage

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
#: Turns of one block of a long conversation; a task orders one block.
BLOCK = 1024


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per row, with content, parent_turn, root_turn, reply_depth, position, n_quotes, n_linked, message.

    ``content``: the text without quoted lines, outer white space trimmed; ``parent_turn``: the turn it replies to, null
    if no quote was found again; ``root_turn``: the turn that its thread began with; ``reply_depth``: steps up to there; ``position``:
    0, 1, ... through the conversation, thread by thread (by root_turn), each in order of turn, so after what it
    replies to; ``n_quotes``, ``n_linked``: quoted passages, and those found; ``message``: role and content as JSON.
    Null and empty texts have empty content and no quotes. Rows of one conversation and turn are ordered by role and text;
    a quote refers to the first of them. A null conv_id is a conversation of its own, a null turn is before all others;
    an empty table gives no rows; other columns are ignored.
    """
    own = messages.select(
        F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("at"), "conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("conv", F.coalesce("conv", F.lit(-(2**63))))
    order = Window.partitionBy("conv", "at").orderBy("role", "text")
    rows = stage(own.withColumn("same", F.row_number().over(order)), "messages")
    passages = stage(_passages(rows), "passages")
    found = _found(passages)
    quotes = passages.where("level > 0").groupBy("conv", "at", "same").agg(F.count("*").alias("n_quotes"))
    linked = found.groupBy("conv", "at", "same").agg(F.count("*").alias("n_linked"), F.max(F.struct(-F.col("level"), F.col("source").alias("parent")))["parent"].alias("parent"))
    key = ["conv", "at", "same"]
    linked = stage(rows.select(*key).join(linked, key, "left").join(quotes, key, "left"), "linked")
    threads = _threads(linked.where("same = 1").select("conv", "at", "parent"))
    roots = threads.select("conv", F.col("at").alias("parent"), F.col("root").alias("above"), F.col("depth").alias("over"))
    tied = linked.join(roots, ["conv", "parent"], "left").withColumn("root", F.coalesce("above", "at")).withColumn("depth", F.coalesce(F.col("over") + 1, F.lit(0)))
    placed = _positions(stage(tied.select(*key, "parent", "root", "depth", "n_quotes", "n_linked"), "tied"))
    content = _content(F.col("text"))
    turn = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    out = rows.join(placed, key).withColumn("content", content)
    return out.select(
        "conv_id", "turn", "role", "content", turn("parent").alias("parent_turn"), turn("root").alias("root_turn"), F.col("depth").cast("long").alias("reply_depth"), "position",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.to_json(F.struct("role", "content")).alias("message"),
    )


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def _content(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: _level(x) == 0)
    return F.trim(F.array_join(lines, "\n"), F.lit(" \t\r\n"))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def _passages(rows: DataFrame) -> DataFrame:
    """(conv, at, same, n, level, line_names, name): passages of one level each, by hashes of their lines and their whole."""
    lines = rows.select("conv", "at", "same", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    lines = lines.select("conv", "at", "same", "i", _level(F.col("line")).alias("level"), _normal(F.col("line")).alias("line")).where("line <> ''")
    message = Window.partitionBy("conv", "at", "same").orderBy("i")
    new = (F.col("level") != F.lag("level", 1, -1).over(message)).cast("int")
    lines = lines.withColumn("new", new).withColumn("n", F.sum("new").over(message))
    gathered = lines.groupBy("conv", "at", "same", "n", "level").agg(F.array_sort(F.collect_list(F.struct("i", "line")))["line"].alias("said"))
    names = F.transform("said", lambda x: F.sha2(x, 256))
    return gathered.select("conv", "at", "same", "n", "level", names.alias("line_names"), F.sha2(F.array_join("said", "\n"), 256).alias("name"))


def _found(passages: DataFrame) -> DataFrame:
    """(conv, at, same, n, level, source): the turn that a quoted passage was said in, if any."""
    said = passages.where("level = 0")
    own = said.select("conv", "at", F.explode(F.concat(F.array(F.concat(F.lit("p"), "name")), F.transform("line_names", lambda x: F.concat(F.lit("l"), x)))).alias("name")).distinct()
    quoted = passages.where("level > 0").select("conv", "at", "same", "n", "level", F.explode(F.concat(F.array(F.concat(F.lit("p"), "name")), F.transform("line_names", lambda x: F.concat(F.lit("l"), x)))).alias("name"))
    wanted = quoted.select("conv", "name").distinct()
    events = own.join(wanted, ["conv", "name"], "left_semi").select("conv", "name", "at", F.col("at").alias("source"))
    asks = quoted.select("conv", "name", "at").distinct().select("conv", "name", "at", F.lit(None).cast("long").alias("source"))
    # At one turn the question comes first: a message does not quote itself.
    events = stage(events.unionByName(asks).withColumn("block", F.floor(F.col("at") / BLOCK)), "events")
    inside = Window.partitionBy("conv", "name", "block").orderBy("at", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last("source", ignorenulls=True)
    blocks = events.groupBy("conv", "name", "block").agg(F.max("source").alias("top"))
    earlier = Window.partitionBy("conv", "name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "name", "block", F.max("top").over(earlier).alias("before"))
    told = events.withColumn("near", latest.over(inside)).where("source is null").join(blocks, ["conv", "name", "block"])
    told = told.select("conv", "name", "at", F.coalesce("near", "before").alias("source")).where("source is not null")
    rank = F.struct(F.col("name").startswith("p").alias("whole"), F.col("source").alias("turn"))
    return quoted.join(told, ["conv", "name", "at"]).groupBy("conv", "at", "same", "n", "level").agg(F.max(rank)["turn"].alias("source"))


def _threads(turns: DataFrame) -> DataFrame:
    """(conv, at, parent) -> (conv, at, root, depth) by doubling: each step looks twice as far up."""
    state = stage(turns.select("conv", "at", F.coalesce("parent", "at").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth")), "threads")
    while True:
        up = state.select("conv", F.col("at").alias("root"), F.col("root").alias("top"), F.col("depth").alias("more"))
        after = stage(state.join(up, ["conv", "root"]).select("conv", "at", F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "threads")
        drop_staged(state)
        state = after
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def _positions(rows: DataFrame) -> DataFrame:
    """Adds ``position``: numbers through each conversation by (root, at, same), block by block of turns."""
    dealt = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    sizes = dealt.groupBy("conv", "root", "block").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("root", "block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("conv", "root", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("conv", "root", "block").orderBy("at", "same")) - 1
    return dealt.withColumn("inside", inside).join(shift, ["conv", "root", "block"]).withColumn("position", F.col("shift") + F.col("inside")).drop("block", "inside", "shift")
