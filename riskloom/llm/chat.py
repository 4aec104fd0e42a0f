"""Chat formatting of reply trees: every chosen root-to-leaf path becomes one conversation.

Messages point to the message they answer. Iterative self-joins follow the replies: in
round k a message knows its ancestor 2**k above and the sums (messages, characters,
scores) of all between, so the deepest tree takes as many rounds as its depth has binary digits.
Branches are ranked by the sum of their messages' scores; the chosen leaves are then
joined upwards in the same steps to all messages of their paths.

The template is ``<|im_start|>role\ntext<|im_end|>\n``. In texts and roles every ``<`` that is
followed by backslashes and a bar gets one backslash more, so no control string is left in
them, and taking it away again gives the text back. A path is written in parts, cut between
messages by their place in characters, so that no task gathers a long conversation; a mask
lists the spans of each part that are trained on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.tables import with_position
from riskloom.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)
#: Characters after which a new part begins.
PART = 1 << 16
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)")


def escaped(value: Column) -> Column:
    """A text without control strings."""
    return F.regexp_replace(value, r"<(\\*)\|", r"<\\$1|")


def unescaped(value: str) -> str:
    return _ESCAPED.sub(r"<\1|", value)


def escaped_role(value: Column) -> Column:
    """A role in one line without control strings."""
    return escaped(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(value: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescaped(value))


def replies(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn answers the one before.

    Takes conv_id, turn, role and text; other columns are ignored. Returns conv_id, node, parent,
    role, text, score (0). Turns are ordered by turn (null first), then role, then a digest of
    the text, so repeated rows stay and equal turns have a fixed order. Rows without
    conv_id are one conversation. A conversation of any size is spread over many tasks.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.md5("text")]
    placed = with_position(rows, order, "node")
    first = materialize(placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("node").alias("_first")), "first_turns")
    return placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "node", F.when(F.col("node") > F.col("_first"), F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _followed(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Root, depth, characters and score of every message's path, and the links of each round.

    ``links`` has node, jump (null at roots), depth, chars, score of each message by itself.
    """
    state = materialize(links.withColumn("root", F.when(F.col("jump").isNull(), F.col("node"))), "replies")
    n = state.count()
    done, active = state.where("jump IS NULL"), state.where("jump IS NOT NULL")
    jumps = []
    while len(jumps) <= n.bit_length() and not active.isEmpty():
        jumps.append(active.select("node", "jump"))
        ends = done.unionByName(active).select(*[F.col(c).alias(f"_{c}") for c in links.columns], F.col("root").alias("_root"))
        further = active.join(ends, F.col("jump") == F.col("_node")).select(
            "node", F.col("_jump").alias("jump"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("depth", "chars", "score")], F.col("_root").alias("root"))
        further = materialize(further, "replies")
        done, active = done.unionByName(further.where("jump IS NULL")), further.where("jump IS NOT NULL")
    return done, jumps


def format_paths(messages: DataFrame, keep: int = 1, part: int = PART, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Formatted conversations of the ``keep`` best branches of every reply tree.

    Takes conv_id, node (unique), parent (null or unknown: a root), role, text, score; other columns are
    ignored. Null role and text count as empty, null score as 0. Branches rank by the sum
    of their scores, ties by the smaller leaf. Messages whose ancestors form a circle have no
    root and are on no path. Returns a row per part: conv_id, root, leaf, rank, part, formatted,
    spans (start and end in characters of what is trained on). Parts of a path in order
    make up its text. Empty tables give no rows. ``messages`` is read twice; pass a written table.
    """
    own = F.concat(F.lit(START), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    rendered = messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), own.alias("head"), body.alias("body"),
                               F.coalesce(F.col("role").isin(*trained), F.lit(False)).alias("trained"))
    rendered = rendered.withColumn("chars", F.length("head") + F.length("body") + len(END) + 1)
    links = rendered.select("node", "parent", F.lit(1).cast("long").alias("depth"), F.col("chars").cast("long").alias("chars"), "score")
    links = materialize(links, "links")
    known = links.select(F.col("node").alias("jump"))
    answered = links.select(F.col("parent").alias("_parent"))
    links = links.join(known, F.col("parent") == F.col("jump"), "left").select("node", "jump", "depth", "chars", "score")
    paths, jumps = _followed(links)

    leaves = paths.join(answered, F.col("node") == F.col("_parent"), "left_anti").select("root", F.col("node").alias("leaf"), "score")
    best = Window.partitionBy("root").orderBy(F.desc("score"), "leaf")
    leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).drop("score")
    on_path = materialize(leaves.withColumn("at", F.col("leaf")), "paths")
    for links in jumps:
        upwards = on_path.join(links, F.col("at") == F.col("node")).select("root", "leaf", "rank", F.col("jump").alias("at"))
        on_path = on_path.unionByName(materialize(upwards, "paths"))

    ends = paths.select(F.col("node").alias("at"), "depth", F.col("chars").alias("end"))
    placed = on_path.join(ends, "at").join(rendered.select("conv_id", F.col("node").alias("at"), "head", "body", "trained", "chars"), "at")
    start = F.col("end") - F.col("chars")
    turn = F.struct("depth", start.alias("start"), "head", "body", "trained")
    parts = placed.withColumn("part", F.floor(start / part)).groupBy("root", "leaf", "rank", "part").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n"))))
    begin = F.col("turns")[0]["start"]
    masked = F.filter("turns", lambda t: t["trained"])
    spans = F.transform(masked, lambda t: F.struct(
        (t["start"] - begin + F.length(t["head"])).alias("start"), (t["start"] - begin + F.length(t["head"]) + F.length(t["body"])).alias("end")))
    return parts.select("conv_id", "root", "leaf", "rank", "part", text.alias("formatted"), spans.alias("spans"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns and trained text of each path, from its parts in order."""
    key, row, turns, loss = None, {}, None, None

    def closed() -> dict:
        return row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if key != r["leaf"]:
                if key is not None:
                    done.append(closed())
                key, turns, loss = r["leaf"], hashlib.sha256(), hashlib.sha256()
                row = {"conv_id": r["conv_id"], "root": r["root"], "leaf": key, "rank": r["rank"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
            formatted = r["formatted"]
            row["formatted_chars"] += len(formatted)
            for found in _TURN.finditer(formatted):
                row["n_turns"] += 1
                turns.update(f"{unescaped_role(found[1])}\n{unescaped(found[2])}\n".encode())
            for span in r["spans"]:
                text = unescaped(formatted[span["start"]:span["end"]])
                row["loss_chars"] += len(text)
                loss.update(text.encode())
        yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
    if key is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema=_DIGESTS)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("root", pa.int64()), ("leaf", pa.int64()), ("rank", pa.int32()), ("n_turns", pa.int64()),
                      ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns, trained text and length of each path.

    Takes the parts that ``format_paths`` gives. Returns conv_id, root, leaf, rank, n_turns,
    turns_sha256 (role, newline, text, newline of every turn), loss_chars, loss_sha256 (all text
    under the mask, unescaped), formatted_chars. A path's parts pass one task as a stream.
    """
    rows = formatted.select("conv_id", "root", "leaf", "rank", "part", "formatted", "spans")
    rows = rows.repartition("leaf").sortWithinPartitions("leaf", "part")
    return rows.mapInArrow(_digested, "conv_id long, root long, leaf long, rank int, n_turns long, turns_sha256 string, "
                                      "loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Conversations of a table (conv_id, turn, role, text), formatted; see ``replies`` and ``format_paths``."""
    return materialize(format_paths(replies(turns)), "formatted")
