"""Chat formatting of reply trees, in DataFrame functions only.

A forest of messages (tree, node, parent, role, text, score) is walked by pointer doubling: each round joins the table of jumps
with itself, so the depth and the summed score of every node are known after log2(depth) rounds. Leaves are ranked in their tree
by mean score of their path, then depth, then node. For the chosen leaves the same jump tables, from the longest to the shortest,
enumerate the whole path: each round adds the node that far above every node found so far. Each path becomes one conversation.

A turn is written ``<|im_start|>`` role, line feed, text, ``<|im_end|>`` and a line feed. Inside texts and roles every ``<``
followed by any number of backslashes and a bar gets one backslash more, so no control string can stand in them, and removing one
restores them exactly. In roles, backslashes and line feeds are escaped first. The loss mask is the list of spans (start, length,
in code points of the output) of the escaped texts of assistant turns.

Defined cases: null text and null role are empty; a parent that is not in the tree counts as none; nodes on a cycle have no root
and are not written; repeated nodes must be numbered apart first (``from_turns`` does, ties in order of role and text); a null
conversation id is a conversation of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

START, END = "<|im_start|>", "<|im_end|>"
MOST_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth): the nodes of the ``branches`` best paths of each tree; ``tree`` is never null here."""
    ids = cut(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    first = cut(ids.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("depth")))
    # nodes whose root is reached leave the rounds; only the others are joined again
    rooted, live, jumps = first.filter("up is null"), first.filter("up is not null"), []
    while len(jumps) < MOST_ROUNDS and not live.isEmpty():
        jumps.append(live.select("tree", "node", "up"))
        above = rooted.unionByName(live).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("depth").alias("_depth"))
        jumped = live.join(above, ["tree", "up"])
        jumped = cut(jumped.select("tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("depth") + F.col("_depth")).alias("depth")))
        rooted, live = rooted.unionByName(jumped.filter("up is null")), jumped.filter("up is not null")
    rooted = cut(rooted.select("tree", "node", "score", "depth"))
    parents = ids.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("score") / F.col("depth")).desc(), F.col("depth").desc(), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    found = cut(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node"))
    for jump in reversed(jumps):
        up = found.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"))
        found = cut(found.unionByName(up))
    return found.join(rooted.select("tree", "node", "depth"), ["tree", "node"])


def render(messages: DataFrame, found: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): one conversation for each path."""
    rows = found.join(messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = F.sum(F.length("piece").cast("long")).over(Window.partitionBy("tree", "leaf").orderBy("depth")) - F.length("piece")
    rows = rows.withColumn("start", before + F.length("head"))
    span = F.struct(F.col("start").alias("start"), F.length("body").cast("long").alias("length"))
    turns = F.sort_array(F.collect_list(F.struct("depth", "piece", F.when(F.col("role") == "assistant", span).alias("span"))))
    out = rows.groupBy("tree", "leaf", "rank").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"])
    return out.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    return render(messages, paths(messages, branches))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    own = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        rest = F.length(piece) - F.length(role) - 1 - len(END) - 1
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(piece, F.length(role) + 2, rest)).alias("text"))

    return F.transform(own, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text) whose turns answer the turn before them."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = rows.select(tree.alias("tree"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the written conversations alone."""
    rows = formatted.withColumn("turns_", parsed(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
    text = F.array_join(F.transform("turns_", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"), F.size("turns_").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
