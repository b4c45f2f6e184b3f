"""Chat formatting of reply trees: self-joins enumerate root-to-leaf paths, each chosen path is one conversation.

Messages form trees by (tree, node, parent). Jump pointers are doubled by
self-joins, so paths of any depth take logarithmically many joins: jump k of a
node is its 2^k-th ancestor. A round joins and writes only the nodes that have
not arrived at their root; those that have stay where they were written. Leaves
are ranked by the score of their branch, and the best ones of each tree are
unfolded into their nodes by halving; a leaf enters at the halving that its depth
needs. All joins are on (tree, node), so one huge tree is spread like
many small ones; they are shuffled, as small files of even numbers unfold into
large relations. Only the messages of one finished conversation meet in a row,
which is what it is.

The template marks turns; control strings inside texts get an escape character
that reading back removes. The loss mask covers the text of assistant turns.

Null texts and roles are empty. Empty tables give empty results. A parent that
does not exist makes a root; nodes on a cycle, which has no root, belong to no
path. Among equally scored branches the smaller leaf wins. linear_trees
numbers the turns, so repeated rows stay separate turns, nulls come first, and a
null id is a conversation like any other; elsewhere (tree, node) must be unique.
Columns beyond those named are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from profseek.functions.shared import checkpointed

#: Template: every turn is OPEN role MIDDLE text CLOSE.
ASSISTANT = "assistant"
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_TURN = r"(?s)^### ((?:\\.|[^:\\])*+): (.*)$"


def escape(text: Column) -> Column:
    """A backslash before every backslash, opening mark and end mark."""
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>|:)", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"(\\|###|</turn>|:)", r"\\$1")


def linear_trees(df: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Messages of plain conversations as trees: every turn replies to the one before it.

    Turns are numbered over the whole table, which is range-partitioned, so that
    a huge conversation is numbered by many tasks.
    """
    rows = df.select(F.struct(F.col(tree).alias("id")).alias("tree"), F.col(order).alias("o"),
                     F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = checkpointed(rows.repartitionByRange("tree", "o", "role").withColumn("part", F.spark_partition_id()), "turns")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("tree", F.col("o").asc_nulls_first(), "role", "text")
    node = F.row_number().over(within) + F.col("offset")
    numbered = parts.join(F.broadcast(sizes), "part").withColumn("node", node.cast("long"))
    # the turn before a first one is in another tree, and so no node of this one
    return checkpointed(numbered.select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text",
                                        F.lit(0.0).alias("score")), "messages")


def _merged(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by shuffle: the size of a file of narrow, even rows says little about the relation it would make."""
    return left.join(right.hint("merge"), keys, how)


def branches(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, branch, place, node) of the root-to-leaf paths, the `keep` best per tree or all; place from 0.

    `messages` has tree, node, parent and score; a branch's score is the sum over
    its nodes. Branches are numbered from 1, best first.
    """
    def written(df: DataFrame) -> tuple[DataFrame, int, int]:
        """The rows stored, their number and how many have not arrived."""
        seen = Observation()
        rows = checkpointed(df, "jump", seen, rows=F.count(F.lit(1)), open=F.count("up"))
        return rows, seen.get["rows"], seen.get["open"]

    # up: the ancestor 2^k steps above; gain: the score of the node and those below that ancestor; depth likewise
    start = messages.select("tree", "node", F.col("parent").alias("up"),
                            F.coalesce("score", F.lit(0.0)).cast("double").alias("gain"), F.lit(1).cast("long").alias("depth"))
    rows, total, left = written(start)
    jumps, arrived = [rows], rows.filter("up IS NULL")
    while left and 2 ** (len(jumps) - 1) <= 2 * total:  # beyond it only nodes below a cycle are left
        on_way = jumps[-1].filter("up IS NOT NULL")
        above = arrived.unionByName(on_way).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("gain").alias("more"),
            F.col("depth").alias("deeper"), F.lit(True).alias("there"))
        met = _merged(on_way, above, ["tree", "up"], "left")
        # without a match in the first round the parent does not exist, and the node is a root
        rows, _, left = written(met.select(
            "tree", "node", F.col("far").alias("up"), (F.col("gain") + F.coalesce("more", F.lit(0.0))).alias("gain"),
            (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth")))
        jumps.append(rows)
        arrived = arrived.unionByName(rows.filter("up IS NULL"))
    inner = start.filter("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = _merged(arrived, inner, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("gain"), "node")
    ranked = leaves.withColumn("branch", F.row_number().over(best).cast("long"))
    if keep is not None:
        ranked = ranked.filter(F.col("branch") <= keep)
    # stretches (node, size): the node and the size - 1 nodes above it; place counts from the leaf
    ranked = checkpointed(ranked.select("tree", F.col("node").alias("leaf"), "branch", F.col("depth").alias("length"), "node",
                                        F.lit(0).cast("long").alias("place"), F.col("depth").alias("size")), "leaves")
    parts = ranked.limit(0)
    for k in range(len(jumps) - 1, 0, -1):
        half = 2 ** (k - 1)
        jump = jumps[k - 1].select("tree", "node", "up")
        entering = ranked.filter((F.col("size") > half) & (F.col("size") <= 2 * half))
        both = parts.unionByName(entering) if k < len(jumps) - 1 else entering
        lower = F.struct("node", "place", F.least("size", F.lit(half).cast("long")).alias("size"))
        upper = F.struct(F.col("up").alias("node"), (F.col("place") + half).alias("place"),
                         (F.col("size") - half).alias("size"))
        split = F.when(F.col("size") > half, F.array(lower, upper)).otherwise(F.array(lower))
        split_up = _merged(both, jump, ["tree", "node"], "left").select("tree", "leaf", "branch", "length", F.inline(split))
        # stored, as a plan of all halvings would grow with the depth
        parts = checkpointed(split_up, "parts") if k > 1 else split_up
    parts = parts.unionByName(ranked.filter("size = 1"))
    return parts.select("tree", "leaf", "branch", (F.col("length") - 1 - F.col("place")).alias("place"), "node")


def formatted(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """One conversation per chosen path: tree, leaf, branch, conversation and loss_spans.

    A loss span is (start, length) in code points of the conversation and covers
    an assistant text, escapes included, without the marks around it.
    """
    path = branches(messages, keep)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit(MIDDLE))
    turns = _merged(path, messages.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "branch", "place", (role == ASSISTANT).alias("trained"), F.length(head).alias("head"),
        F.concat(head, escape(text), F.lit(CLOSE)).alias("turn"))
    before = Window.partitionBy("tree", "leaf", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0).cast("long"))
    placed = turns.withColumn("start", start + F.col("head")).withColumn(
        "chars", F.length("turn") - F.col("head") - len(CLOSE))
    row = F.struct("place", "turn", "trained", "start", "chars")
    grouped = placed.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]),
                        lambda t: F.struct(t["start"].cast("int").alias("start"), t["chars"].alias("length")))
    return grouped.select("tree", "leaf", "branch", F.array_join(F.transform("turns", lambda t: t["turn"]), "")
                          .alias("conversation"), spans.alias("loss_spans"))


def read_back(conversation: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    turns = F.slice(F.split(conversation, CLOSE), 1, F.size(F.split(conversation, CLOSE)) - 1)
    return F.transform(turns, lambda t: F.struct(unescape(F.regexp_extract(t, _TURN, 1)).alias("role"),
                                                 unescape(F.regexp_extract(t, _TURN, 2)).alias("text")))


def masked_text(conversation: Column, loss_spans: Column) -> Column:
    """Unescaped text under the loss mask."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(
        F.substring(conversation, s["start"] + 1, s["length"]))), "")
