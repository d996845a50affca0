"""Chat formatting: root-to-leaf paths of reply trees, each formatted as one conversation.

A node names its parent. Self-joins double, round by round, how far each node sees
up its tree, so a path of depth d takes log2(d) joins; they give each leaf the sum
of scores on its path, and the same jump tables then list the nodes of the paths
that were chosen. Texts meet their paths only after that choice.

Template: ``### role: text</turn>`` and a line end for each turn. Backslash, ``#``,
``<`` (and ``:`` in roles) carry a backslash inside texts, so no text can hold a
marker, and taking it away gives the text back. The loss mask is a list of spans,
in code points of the conversation: the texts of the assistant.

Defined results: a null text or role is empty; a null tree is a tree of its own; a
node whose parent is missing is a root; nodes on or above no root (cycles) are in
no path; rows that repeat a (conv_id, turn) follow one another by role and text; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.llm import common

LOSS_ROLE = "assistant"
#: Characters of a conversation in one row of the formatted table; longer ones go on in further rows.
PART_CHARS = 1 << 24

_ESCAPED, _ESCAPED_ROLE, _BACK = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and stops."""
    head = f"### {_ESCAPED_ROLE.sub(r'\\\g<0>', role)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def turns_of(text: str):
    """(role, text) of each turn of a formatted conversation."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"not a turn at {at}: {text[at : at + 40]!r}")
        yield unescape(found[1]), unescape(found[2])
        at = found.end()


def chosen_paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, place, node) of the ``per_tree`` best paths of each tree (all, if None).

    ``nodes``: tree, node (unique in its tree), parent, score. Paths are ranked by
    their mean score, then their length, then their leaf.
    """
    known = nodes.select("tree", F.col("node").alias("anc")).withColumn("there", F.lit(1))
    jump = nodes.select("tree", "node", F.col("parent").alias("anc"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("size"))
    jump = jump.join(known, (jump["tree"].eqNullSafe(known["tree"])) & (jump["anc"] == known["anc"]), "left").select(jump["tree"], "node", F.when(F.col("there") == 1, jump["anc"]).alias("anc"), "total", "size")
    jump = common.settle(jump, "jump")
    n = jump.count()
    jumps, rounds = [], max(1, n.bit_length() + 1)
    for _ in range(rounds):
        jumps.append(jump.filter("anc is not null").select("tree", "node", "anc"))
        if jumps[-1].isEmpty():
            break
        # only what has not reached its root goes on; the others are looked up
        active = jump.filter("anc is not null")
        up = jump.toDF("up_tree", "up_node", "up_anc", "up_total", "up_size")
        joined = active.join(up, active["tree"].eqNullSafe(up["up_tree"]) & (active["anc"] == up["up_node"]), "left")
        further = joined.select("tree", "node", F.col("up_anc").alias("anc"), (F.col("total") + F.coalesce("up_total", F.lit(0.0))).alias("total"), (F.col("size") + F.coalesce("up_size", F.lit(0))).alias("size"))
        jump = common.settle(jump.filter("anc is null").unionByName(further), "jump")
    parents = nodes.filter("parent is not null").select(F.col("tree").alias("p_tree"), F.col("parent").alias("p_node")).distinct()
    rooted = jump.filter("anc is null")  # what still has an ancestor is on a cycle
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["p_tree"]) & (rooted["node"] == parents["p_node"]), "left_anti")
    if per_tree is not None:
        best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("size")), F.desc("size"), "node")
        leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_tree)
    paths = leaves.select("tree", F.col("node").alias("leaf"), F.col("size").alias("place"), "node")
    paths = common.settle(paths, "paths")
    for k in reversed(range(len(jumps))):
        up = jumps[k].toDF("up_tree", "up_node", "up_anc")
        more = paths.join(up, paths["tree"].eqNullSafe(up["up_tree"]) & (paths["node"] == up["up_node"])).select("tree", "leaf", (F.col("place") - (1 << k)).alias("place"), F.col("up_anc").alias("node"))
        paths = common.settle(paths.unionByName(more), "paths")  # else each round would run all before it twice
    return paths


def formatted(nodes: DataFrame, per_tree: int | None = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """tree, leaf, part, text, loss_spans of the best paths of each tree.

    ``nodes``: tree, node, parent, role, text, score. A task reads a conversation's
    turns in order and holds one part of it at a time.
    """
    common.arrow_batches(nodes.sparkSession)
    paths = chosen_paths(nodes, per_tree)
    turns = nodes.select(F.col("tree").alias("n_tree"), F.col("node").alias("n_node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(turns, paths["tree"].eqNullSafe(turns["n_tree"]) & (paths["node"] == turns["n_node"])).select("tree", "leaf", "place", "role", "text")
    rows = rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        now, part, pieces, spans, base, size = None, 0, [], [], 0, 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([part], pa.int32()), pa.array(["".join(pieces)]), pa.array([spans], spans_type)],
                names=["tree", "leaf", "part", "text", "loss_spans"],
            )

        for batch in batches:
            for tree, leaf, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (tree, leaf):
                    if now is not None:
                        yield row()
                    now, part, pieces, spans, base, size = (tree, leaf), 0, [], [], 0, 0
                elif size > PART_CHARS:
                    yield row()
                    part, pieces, spans, base, size = part + 1, [], [], base + size, 0
                whole, start, stop = turn_text(role, text)
                if role == loss_role:
                    spans.append({"start": base + size + start, "stop": base + size + stop})
                pieces.append(whole)
                size += len(whole)
        if now is not None:
            yield row()

    return rows.mapInArrow(run, "tree long, leaf long, part int, text string, loss_spans array<struct<start:long,stop:long>>")


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of each formatted conversation, from its text and loss spans alone."""
    rows = conversations.select("tree", "leaf", "part", "text", "loss_spans").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "part")
    schema = "conv_id long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        now, done = None, []

        def out():
            columns = list(zip(*done, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def close():
            done.append((*now, turns, all_turns.hexdigest(), loss, all_loss.hexdigest(), chars))

        for batch in batches:
            for tree, leaf, _, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (tree, leaf):
                    if now is not None:
                        close()
                        if len(done) >= 1000:
                            yield out()
                            done = []
                    now, turns, loss, chars, all_turns, all_loss = (tree, leaf), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in turns_of(text):
                    turns += 1
                    all_turns.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] - chars : s["stop"] - chars])
                    loss += len(said)
                    all_loss.update(said.encode())
                chars += len(text)
        if now is not None:
            close()
            yield out()

    return rows.mapInArrow(run, schema)


def linear(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as trees without branches: each turn replies to the one before."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op6_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    nodes = common.settle(linear(rows.unionByName(extra)), "turns")
    return read_back(formatted(nodes)).drop("leaf")
