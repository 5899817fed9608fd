"""Conversations from reply trees, formatted for training with a loss mask.

A message has a tree (conv_id), an id and a parent. Ancestor tables at distances 1, 2, 4, ... come
from iterative self-joins, so a chain of n replies takes log2(n) rounds. Their sums give each
message's depth and the score of its branch; leaves are ranked per tree, and only the chosen
branches are spelled out, again by self-joins with the same tables.

Defined results: null text, role or score count as empty, empty and 0; a message whose parent is
missing starts a branch; rows of one conversation with equal turns follow each other by role and
text; messages on a cycle have no root and are left out; rows without a conv_id or message id are left out; of rows
with one message id the first by parent, role, text and score counts; extra columns are ignored; an empty table gives no rows. A
conversation is one output row, so its formatted text must fit a task, as the format asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, text_rows

START, END = "<|im_start|>", "<|im_end|>"
#: More rounds than any chain can need: 2**40 replies.
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    """One more backslash between < and |, so that no control string can stand inside a text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role must also stay on one line."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def linear_tree(rows: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) as trees in which each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return text_rows(rows, "conv_id", "turn", "role", "text").withColumn("msg", F.row_number().over(order).cast("long")).select("conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def ancestors(tree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf candidates with depth and branch score, tables of each message's ancestor at distance 2**k)."""
    ids = tree.select("conv_id", "msg")
    parent = tree.select("conv_id", F.col("parent").alias("msg")).filter("msg IS NOT NULL")
    known = parent.join(ids, ["conv_id", "msg"], "left_semi").distinct().withColumnRenamed("msg", "parent").withColumn("known", F.lit(True))
    now = tree.join(known, ["conv_id", "parent"], "left").select("conv_id", "msg", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(0).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"))
    now = now.withColumn("depth", F.when(F.col("up").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    # rounds carry on only the messages whose root is still above
    now, steps = cut(now), []
    settled, now = now.filter("up IS NULL"), now.filter("up IS NOT NULL")
    for _ in range(MAX_ROUNDS):
        if now.isEmpty():
            break
        steps.append(now.select("conv_id", "msg", "up"))
        above = now.unionByName(settled).select("conv_id", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        now = cut(now.join(above, ["conv_id", "up"]).select("conv_id", "msg", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total")))
        settled = settled.unionByName(now.filter("up IS NULL"))
        now = now.filter("up IS NOT NULL")
    return settled, steps


def branches(tree: DataFrame, keep: int = 1) -> DataFrame:
    """conv_id, branch, depth, role, text of the keep best root-to-leaf paths of each tree.

    A branch's score is the mean score of its messages; ties go to the longer branch, then to the
    smaller leaf id. branch counts from 0 in that order.
    """
    tree = cut(text_rows(tree, "conv_id", "msg", "parent", "role", "text", "score").filter("conv_id IS NOT NULL AND msg IS NOT NULL"))
    if not tree.groupBy("conv_id", "msg").count().filter("count > 1").isEmpty():
        # else every repeated message would double its replies
        first = Window.partitionBy("conv_id", "msg").orderBy("parent", "role", "text", "score")
        tree = cut(tree.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n"))
    reach, steps = ancestors(tree)
    parents = tree.select("conv_id", F.col("parent").alias("msg")).filter("msg IS NOT NULL").distinct()
    leaves = reach.join(parents, ["conv_id", "msg"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "msg")) - 1
    paths = leaves.withColumn("branch", rank).filter(F.col("branch") < keep).select("conv_id", "branch", "msg")
    for step in steps:
        paths = cut(paths)
        paths = paths.unionByName(paths.join(step, ["conv_id", "msg"]).select("conv_id", "branch", F.col("up").alias("msg")))
    depth = reach.select("conv_id", "msg", "depth")
    return paths.join(depth, ["conv_id", "msg"]).join(tree.select("conv_id", "msg", "role", "text"), ["conv_id", "msg"]).select("conv_id", "branch", "depth", "role", "text")


def formatted(path_rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per branch: conv_id, branch, text and loss_spans (start, length in code points of the text)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = path_rows.select("conv_id", "branch", "depth", (F.col("role") == trained_role).alias("trained"), head.alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.coalesce("trained", F.lit(False)), F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))
    parts = F.array_sort(F.collect_list(F.struct("depth", "piece", span.alias("span"))))
    out = rows.groupBy("conv_id", "branch").agg(parts.alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull())
    return out.select("conv_id", "branch", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"), spans.alias("loss_spans"))


def read_back(out: DataFrame) -> DataFrame:
    """The turns and the trained text, parsed from the formatted text and its loss mask alone."""
    turns = F.slice(F.split("text", r"<\|im_start\|>"), 2, 1_000_000_000)
    parsed = F.transform(turns, lambda t: F.struct(unescape_role(F.substring_index(t, "\n", 1)).alias("role"), unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t) - F.instr(t, "\n") - len(END) - 1)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return out.select("conv_id", "branch", "text", parsed.alias("turns"), loss.alias("loss_text"))


def digests(out: DataFrame) -> DataFrame:
    back = read_back(out)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))
