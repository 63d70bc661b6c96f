"""Operator 7: chat formatting of reply trees, with DataFrame functions only.

Method: every message points to the one it answers.  Iterative self-joins
double the pointers, so that after log2(depth) rounds each message knows its
root, its depth and the score summed over its path; leaves are ranked by mean
score within their tree, the same doubled pointers mark the chosen leaf's
ancestors, and each chosen path is formatted as one conversation.

Template: ``### <role>: <text>\\n</turn>\\n`` for each turn.  Inside texts a
backslash is doubled, ``###`` is written ``\\###`` and ``</turn>`` is written
``<\\/turn>``; a colon inside a role is written ``\\:``.  So the turn mark never
occurs inside a text, and removing one backslash before any character restores it.

Contract: a message whose parent is missing from its tree is a root.  Null
roles and texts are empty.  Null tree ids form one tree.  Ties of score go to
the lower leaf id.  Rows of a conversation are ordered by turn (null first),
then role and text; repeated rows are turns each.  Cycles have no root and are
left out.  Extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

TURN_END = "\n</turn>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, branch (rank, from 1), depth and node of the messages on the best paths.

    ``messages``: tree, node, parent (null: root), score.  Pairs (tree, node)
    are unique; tree is not null.
    """
    own = messages.select("tree", "node", F.col("parent").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = own.select("tree", F.col("node").alias("up"), F.lit(True).alias("there"))
    own = own.join(known, ["tree", "up"], "left").select("tree", "node", F.when(F.col("there"), F.col("up")).alias("up"), "total", F.lit(1).cast("long").alias("length"))
    state = materialise(own)
    jumps = [state.select("tree", "node", "up")]
    while not state.filter("up is not null").isEmpty():
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("length").alias("length2"))
        # Messages that know their root are through; only the others join on.
        joined = state.filter("up is not null").join(above, ["tree", "up"])
        through = state.filter("up is null")
        state = materialise(through.unionByName(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("length") + F.col("length2")).alias("length"))))
        jumps.append(state.select("tree", "node", "up"))
        if len(jumps) > 40:  # longer than any table: what still points up runs in a cycle
            break
    whole = state.filter("up is null").select("tree", "node", "total", "length")
    parents = jumps[0].filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = whole.join(parents, ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "node")))
    paths = materialise(ranked.filter(F.col("branch") <= branches).select("tree", F.col("node").alias("leaf"), "branch", "node"))
    for jump in jumps:
        upward = paths.join(jump.filter("up is not null"), ["tree", "node"]).select("tree", "leaf", "branch", F.col("up").alias("node"))
        paths = materialise(paths.unionByName(upward))
    return paths.join(whole.select("tree", "node", F.col("length").alias("depth")), ["tree", "node"]).select("tree", "leaf", "branch", "depth", "node")


def format_paths(turns: DataFrame) -> DataFrame:
    """tree, leaf, formatted and spans of each path.

    ``turns``: tree, leaf, depth, role, text.  spans: for each turn in order the
    start and length, in code points, of its escaped text within ``formatted``,
    and whether it is under the loss mask (assistant turns are).
    """
    order = Window.partitionBy("tree", "leaf").orderBy("depth")
    turns = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    turns = turns.withColumns({"head": _header(F.col("role")), "body": escape(F.col("text"))})
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(TURN_END)))
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((before + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length"), (F.col("role") == "assistant").alias("loss"))
    placed = turns.select("tree", "leaf", "depth", "piece", span.alias("span"))
    gathered = placed.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "piece", "span"))).alias("turns"))
    return gathered.select("tree", "leaf", F.array_join("turns.piece", "").alias("formatted"), F.col("turns.span").alias("spans"))


def read_back(formatted: Column, spans: Column) -> Column:
    """The turns that a formatted conversation holds: role, text, loss.

    A span that does not lie exactly on its turn's text makes that text null.
    """
    pieces = F.split(formatted, TURN_END.replace("/", "\\/"))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    ends = F.transform(spans, lambda s: s["start"] + s["length"])
    before = F.concat(F.array(F.lit(-len(TURN_END)).cast("long")), ends)
    rows = F.arrays_zip(pieces.alias("piece"), spans.alias("span"), F.slice(before, 1, F.size(ends)).alias("before"))

    def turn(row: Column) -> Column:
        piece, span = row["piece"], row["span"]
        head = F.length(piece) - span["length"]
        fits = span["start"] == row["before"] + len(TURN_END) + head
        role = F.regexp_extract(piece, r"(?s)^### ((?:[^:\\]|\\.)*+): ", 1)
        text = F.regexp_replace(piece, r"(?s)^### (?:[^:\\]|\\.)*+: ", "")
        under = F.right(piece, span["length"])
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), span["loss"].alias("loss"), F.when(fits, unescape(under)).alias("under"))

    return F.transform(rows, turn)


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each row answers the one before it."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(tree.alias("tree"), "conv_id", "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and spans of every conversation."""
    messages = materialise(conversation_trees(conversations))
    paths = chosen_paths(messages.select("tree", "node", "parent", "score"))
    turns = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    ids = messages.filter("node = 1").select("tree", "conv_id")
    return format_paths(turns).join(ids, "tree").select("conv_id", "formatted", "spans")
