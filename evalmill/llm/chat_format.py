"""Chat formatting of reply trees, in DataFrame functions only.

Root-to-leaf paths are enumerated by iterative self-joins that double the known
part of each path, branches are ranked by score, and each chosen path becomes
one string with marked turns and a loss mask of character spans.

Defined results: a null text or role is empty, a null score counts 0, a null
tree or an unknown parent makes a node a root of its own tree; ties of branches
go to the smaller leaf. Rows that repeat a (tree, node) are ordered by their
texts only in :func:`tree_of_turns`, which numbers turns itself. A cycle of
replies raises ``ValueError``. Empty tables give empty results. Roles and texts
of any length are kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.session import stage

ESC = "␛"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROLS = [OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>"]


def escape(text: Column) -> Column:
    """Break control strings: the escape sign itself becomes ``␛e``, ``<s>`` becomes ``<␛cs>``."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESC), F.lit(ESC + "e"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESC + "c" + control[1:]))
    return out


def escape_role(role: Column) -> Column:
    """Like :func:`escape`, and a line feed becomes ``␛n``: the role ends at the first one."""
    return F.replace(escape(role), F.lit("\n"), F.lit(ESC + "n"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC + "c"), F.lit(""))
    out = F.replace(out, F.lit(ESC + "n"), F.lit("\n"))
    return F.replace(out, F.lit(ESC + "e"), F.lit(ESC))


def tree_of_turns(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    return turns.select(
        F.col("conv_id").alias("tree"),
        node.cast("long").alias("node"),
        F.when(node > 1, node - 1).cast("long").alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """All (tree, leaf, node, up): ``up`` counts the steps from the leaf to the node.

    Round k joins the part of each path that is known so far with the table of
    ancestors 2**k steps up, and that table with itself, so that paths of length
    n take log2(n) rounds. Each round is a written table.
    """
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    links = nodes.filter("parent is not null").join(
        known, nodes["tree"].eqNullSafe(known["t"]) & (nodes["parent"] == known["n"]), "left_semi"
    )
    jump = stage(links.select("tree", "node", F.col("parent").alias("above")), "reply-links")
    inner = jump.select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = nodes.join(inner, nodes["tree"].eqNullSafe(inner["t"]) & (nodes["node"] == inner["n"]), "left_anti")
    path = stage(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "reply-leaves")
    sizes = nodes.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0)))
    most, step = sizes.first()[0], 1
    if path.isEmpty() and most:
        raise ValueError("the replies of every tree form cycles")
    while not jump.isEmpty():
        if step > most:
            raise ValueError("the replies of a tree form a cycle")
        hop = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        further = path.join(hop, path["tree"].eqNullSafe(hop["t"]) & (path["node"] == hop["n"])).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up")
        )
        path = stage(path.unionByName(further), "reply-paths")
        low = jump.select("tree", "node", F.col("above").alias("mid"))
        jump = stage(
            low.join(hop, low["tree"].eqNullSafe(hop["t"]) & (low["mid"] == hop["n"])).select("tree", "node", "above"),
            "reply-jumps",
        )
        step *= 2
    return path


def best_branches(paths: DataFrame, messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """Rank each tree's branches by their mean message score; ``per_tree`` best stay (None: all)."""
    scored = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    joined = paths.join(scored, paths["tree"].eqNullSafe(scored["t"]) & (paths["node"] == scored["n"]))
    branches = joined.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    ranked = branches.withColumn("branch_rank", F.row_number().over(order))
    return ranked if per_tree is None else ranked.filter(F.col("branch_rank") <= per_tree)


def format_branches(
    paths: DataFrame, messages: DataFrame, branches: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One conversation for each branch: tree, leaf, branch_rank, branch_score, formatted, loss_spans.

    ``loss_spans`` holds (start, length) in code points of each text of a loss role.
    """
    chosen = branches.select(F.col("tree").alias("bt"), F.col("leaf").alias("bl"), "branch_rank", "branch_score")
    path = paths.join(chosen, paths["tree"].eqNullSafe(chosen["bt"]) & (paths["leaf"] == chosen["bl"]))
    said = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = path.join(said, path["tree"].eqNullSafe(said["t"]) & (path["node"] == said["n"])).select(
        "tree",
        "leaf",
        "branch_rank",
        "branch_score",
        (-F.col("up")).alias("at"),
        F.coalesce("role", F.lit("")).isin(*loss_roles).alias("loss"),
        F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    size = F.length("head") + F.length("body") + len(CLOSE) + 1
    before = Window.partitionBy("tree", "leaf").orderBy("at")
    turns = turns.withColumn("start", F.sum(size.cast("long")).over(before) - size + F.length("head"))
    each = F.struct("at", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("said"), "loss", "start", F.length("body").alias("chars"))
    rows = turns.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(
        F.array_sort(F.collect_list(each)).alias("turns")
    )
    spans = F.transform(
        F.filter("turns", lambda t: t["loss"]),
        lambda t: F.struct(t["start"].cast("long").alias("start"), t["chars"].cast("long").alias("length")),
    )
    return rows.select(
        "tree",
        "leaf",
        "branch_rank",
        "branch_score",
        F.concat_ws("", F.transform("turns", lambda t: t["said"])).alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda part: part != "")
    inside = F.transform(parts, lambda part: F.substr(part, F.lit(len(OPEN) + 1)))
    return F.transform(
        inside,
        lambda part: F.struct(
            unescape(F.substring_index(part, "\n", 1)).alias("role"),
            unescape(F.substr(part, F.instr(part, F.lit("\n")) + 1)).alias("text"),
        ),
    )


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, without its escapes, nothing between."""
    return F.concat_ws(
        "",
        F.transform(
            spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
        ),
    )


def format_conversations(turns: DataFrame, per_tree: int | None = None) -> DataFrame:
    """Format conversations of flat turns: their trees, paths, branches, strings and masks."""
    messages = stage(tree_of_turns(turns), "messages")
    paths = root_to_leaf_paths(messages)
    return format_branches(paths, messages, best_branches(paths, messages, per_tree))
