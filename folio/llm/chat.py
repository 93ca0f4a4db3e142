"""Chat formatting of reply trees (DataFrame functions only).

Messages form trees: each names its parent. :func:`reply_paths` enumerates root-to-leaf paths by
iterative self-joins that double the distance: after k joins every message knows its ancestor
2**k steps up and the score of the steps between, so a chain of n messages takes about log2(n)
joins. Trees whose paths are complete leave the table, so one deep tree does not keep the others
in it. Leaves are ranked per tree by the score of their whole path; only chosen paths are expanded
to their messages, by the same jump tables. Each step is written to the shared folder, which cuts
the lineage. No step looks at a tree in one task: all joins are on (tree, message).

:func:`format_paths` writes each path as one conversation. The template marks turns with control
strings. Control strings inside roles and texts are escaped: every backslash is doubled, and a
backslash goes after the first character of each control string; :func:`unescape` reverses both.
The loss mask lists, per turn, which characters of the turn's segment are trained on: the text of
assistant turns, without the marks.

Conversation rows (one tree each, a chain) get their positions from :func:`chain`: turns are cut
into blocks, counted and numbered per block, and offset by the counts of earlier blocks, so a
conversation with a third of all rows is numbered by many tasks.

Defined results: a null text or role is empty; a null score counts as 0; a null tree id is a tree
of its own; a missing parent makes a root; rows that repeat a message id of a tree count once (the
smallest row); messages that only lead around a cycle are on no path; equal scores are ranked by
the smaller leaf id; rows of a conversation with equal turns are ordered by role and text, and
null turns come last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

#: Fixed values of the template.
BEGIN, END, TURN, SAYS, STOP = "<s>", "</s>", "<|turn|>", "<|says|>", "<|end|>"
#: First characters of the control strings, followed by the rest of one (instruction marks too).
_CONTROL = r"([<\[])(?=\||/?s>|/?INST\])"
TRAINED_ROLE = "assistant"
BLOCK_TURNS = 64


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit(_CONTROL), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\(\\?)"), F.lit("$1"))


def chain(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """``tree, node, parent, score, role, text``: rows in order of their turn as a chain of messages."""
    rows = rows.select(
        F.col(tree).alias("tree"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("_block", F.coalesce(F.floor(F.col("_turn") / BLOCK_TURNS), F.lit(2**62)))
    counts = rows.groupBy("tree", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("tree").alias("_tree"), F.col("_block").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("tree", "_block").orderBy(F.col("_turn").asc_nulls_last(), "role", "text")
    numbered = rows.withColumn("_k", F.row_number().over(inside)).join(
        counts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_block") == F.col("_of"))
    )
    node = F.col("_offset") + F.col("_k")
    return numbered.select(
        "tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def _same(tree: str, other: str) -> Column:
    return F.col(tree).eqNullSafe(F.col(other))


def reply_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Messages of the ``best`` root-to-leaf paths of each tree (None: of all).

    ``messages(tree, node, parent, score)``; returns ``tree, leaf, rank, path_score, node, depth``
    with depth 0 at the root.
    """
    links = (
        messages.where(F.col("node").isNotNull())
        .groupBy("tree", "node")
        .agg(F.min(F.struct(F.col("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m"))
        .select("tree", "node", "m.parent", "m.score")
    )
    known = links.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    up = links.join(known, _same("tree", "_t") & (F.col("parent") == F.col("_n")), "left").select(
        "tree", "node", F.col("_n").alias("up"), F.col("score").cast("double"), F.lit(1).cast("long").alias("steps")
    )
    jumps = [stored(up, "jump")]
    # After k joins the jumps are 2**k long; a path is no longer than its tree.
    largest = jumps[0].groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    settled = []  # messages of trees whose paths are all known; only deeper trees go on
    while (1 << (len(jumps) - 1)) < largest and not jumps[-1].where(F.col("up").isNotNull()).isEmpty():
        last = jumps[-1]
        active = last.where(F.col("up").isNotNull())
        deep = active.select(F.col("tree").alias("_t")).distinct()
        settled.append(last.join(deep, _same("tree", "_t"), "left_anti"))
        last = last.join(deep, _same("tree", "_t"), "left_semi")
        far = last.select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"),
            F.col("score").alias("_score"), F.col("steps").alias("_steps"),
        )
        joined = active.join(far, _same("tree", "_t") & (F.col("up") == F.col("_n"))).select(
            "tree",
            "node",
            F.col("_up").alias("up"),
            (F.col("score") + F.col("_score")).alias("score"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
        )
        jumps.append(stored(joined.unionByName(last.where(F.col("up").isNull())), "jump"))
    known = reduce(DataFrame.unionByName, [*settled, jumps[-1]])
    parents = links.select(F.col("tree").alias("_t"), F.col("parent").alias("_n"))
    rooted = known.where(F.col("up").isNull())  # messages on a cycle never get there
    leaves = rooted.join(parents, _same("tree", "_t") & (F.col("node") == F.col("_n")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("node"))
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    leaf = ranked.select(
        "tree", F.col("node").alias("leaf"), "rank", F.col("score").alias("path_score"), "node",
        (F.col("steps") - 1).alias("depth"),
    )
    paths = [stored(leaf, "path")]
    for k, jump in enumerate(jumps):  # messages within 2**k steps of the leaf, then within 2**(k+1)
        hop = jump.where(F.col("up").isNotNull()).select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up")
        )
        deep_enough = reduce(DataFrame.unionByName, paths).where(F.col("depth") >= (1 << k))
        more = deep_enough.join(hop, _same("tree", "_t") & (F.col("node") == F.col("_n"))).select(
            "tree", "leaf", "rank", "path_score", F.col("_up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")
        )
        paths.append(stored(more, "path"))
    return reduce(DataFrame.unionByName, paths)


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One conversation per chosen path: ``tree, leaf, rank, formatted`` and ``mask``.

    ``mask`` has per turn the first character and the number of characters trained on, counted
    from the turn's mark (0 characters for turns that are not trained on).
    """
    wording = (
        messages.groupBy("tree", "node")
        .agg(F.min(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])).alias("m"))
        .select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "m.role", "m.text")
    )
    turns = paths.join(wording, _same("tree", "_t") & (F.col("node") == F.col("_n"))).select(
        "tree", "leaf", "rank", "depth", F.col("role").eqNullSafe(TRAINED_ROLE).alias("trained"),
        escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"),
    )
    head = F.concat(F.lit(TURN), F.col("role"), F.lit(SAYS))
    turn = F.struct(
        "depth",
        F.concat(head, F.col("text"), F.lit(STOP)).alias("segment"),
        F.char_length(head).alias("start"),
        F.when(F.col("trained"), F.char_length("text")).otherwise(0).alias("length"),
    )
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "tree",
        "leaf",
        "rank",
        F.concat(F.lit(BEGIN), F.array_join("turns.segment", ""), F.lit(END)).alias("formatted"),
        F.transform(
            "turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))
        ).alias("mask"),
    )


def read_back(formatted: Column, mask: Column) -> dict[str, Column]:
    """What a conversation says, read from its formatted text and mask alone.

    ``turns``: role and text of each turn; ``trained``: the unescaped text under the mask.
    """
    body = F.substr(formatted, F.lit(len(BEGIN) + 1), F.char_length(formatted) - len(BEGIN) - len(END))
    # The text begins with a mark, so the first part is empty.
    parts = F.split(body, r"\Q" + TURN + r"\E", -1)
    segments = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turn(segment: Column) -> Column:
        said = F.split(F.substring_index(segment, STOP, 1), r"\Q" + SAYS + r"\E", -1)
        return F.struct(unescape(said[0]).alias("role"), unescape(said[1]).alias("text"))

    # The mask counts from the mark, which the split removed.
    trained = F.zip_with(
        segments, mask, lambda s, m: unescape(F.substr(s, m["start"] - len(TURN) + 1, m["length"]))
    )
    return {"turns": F.transform(segments, turn), "trained": F.array_join(trained, "")}
