r"""Chat formatting: conversations as paths of reply trees, written with a template that can be read back.

A message has a tree, a number, the number of the message that it replies to,
a role, a text and a score. Iterative self-joins enumerate the paths from the
root to each leaf: in a round, every path that reaches 2**k messages up from
its leaf takes over the ancestor that each of its messages has 2**k steps
above, and the ancestors are doubled by a self-join too. So a tree of any depth
takes as many rounds as its depth has bits, and the rows grow to what is to be
written and no further. Branches are ranked by score (the sum of a path's
messages, then the number of the leaf), and the best of each tree, or all, are
formatted, each as one conversation.

The template: ``<|start|>role\ntext<|end|>`` and a newline for each turn. In roles
and texts a backslash is doubled, and each of the control strings CONTROLS gets
a backslash after its first character; in roles a newline gets one before it.
So no control string of a text is one of the template, and taking single
backslashes out again gives the text back. The loss mask is the texts of the
role assistant: pairs of start and end within the formatted text.

A path is formatted in segments of SEGMENT turns, rows (tree, leaf, segment) of
their own whose texts follow each other, so a very long conversation is the work
of many tasks and never one string; a usual one is one segment.

A null text or role counts as empty, a null score as 0. Messages of a null tree
are a tree of their own. A message whose parent does not exist is a root; one
that is on or below a cycle is on no path. A table of turns (conv_id, turn) is a
chain for each conv_id: rows in the order of turn (nulls first), role, text; of
ties none is lost, and repeated rows are turns of their own. Texts of any length
stay whole. An empty table gives no rows but those of conversation -1 in the
query. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import scan
from quirelake.operators.joins import spread_join

from .common import table, written

START, END = "<|start|>", "<|end|>"
#: What the usual chat templates write between texts. None ends like another begins, so no two overlap.
CONTROLS = ("<|start|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|eot_id|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SPECIAL = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
UNESCAPE = re.compile(r"\\(.)", re.S)
ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)
#: Turns of a segment.
SEGMENT = 256
LEARNED = "assistant"


def escaped(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head = f"{START}{escaped(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for part in formatted.split(START)[1:]:
        head = ROLE.match(part)
        out.append((unescaped(head[1]), unescaped(part[head.end() : -len(END) - 1])))
    return out


# Paths of reply trees -------------------------------------------------------------------------------


def chain(rows: DataFrame, fair: int | None = None) -> DataFrame:
    """Messages (tree, message, parent, role, text, score) of a table of turns (conv_id, turn, role, text)."""
    rows = rows.select(F.struct(F.col("conv_id").alias("of")).alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = scan.row_number(rows, ["tree"], ["turn", "role", "text"], "message", fair)
    return numbered.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, message, up (how many steps the message is above the leaf) of all paths from a root to a leaf.

    messages: tree, message (each once in a tree), parent. tree is not null.
    """
    own = written(messages.select("tree", "message", "parent"), "messages")
    leaf = own.select("tree", F.col("parent").alias("message")).where("message IS NOT NULL").distinct()
    leaves = own.join(leaf, ["tree", "message"], "left_anti").select("tree", "message")
    found = written(leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("up")), "paths")
    # Pointers to messages that exist only.
    there = own.select("tree", F.col("message").alias("parent"))
    above = written(spread_join(own.where("parent IS NOT NULL"), there, ["tree", "parent"]).select("tree", "message", F.col("parent").alias("above")), "above")
    total, length = own.count(), 1
    while not above.isEmpty() and length <= total:
        longer = spread_join(found, above, ["tree", "message"]).select("tree", "leaf", F.col("above").alias("message"), (F.col("up") + length).alias("up"))
        found = found.unionByName(written(longer, "paths"))
        further = above.select("tree", F.col("message").alias("above"), F.col("above").alias("_above"))
        above = written(spread_join(above, further, ["tree", "above"]).select("tree", "message", F.col("_above").alias("above")), "above")
        length *= 2
    if not above.isEmpty():
        # Whoever still climbs comes from a cycle; a leaf above which one lies is on no path.
        lost = above.select("tree", F.col("message").alias("leaf"))
        found = written(found.join(lost, ["tree", "leaf"], "left_anti"), "paths")
    return found


def ranked(found: DataFrame, messages: DataFrame, best: int | None = None) -> DataFrame:
    """found with the branch's score and rank in its tree; the first best of each tree only, if given."""
    scores = spread_join(found.select("tree", "message", "leaf"), messages.select("tree", "message", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "message"])
    branches = scores.groupBy("tree", "leaf").agg(F.sum("score").alias("score")).withColumn("worse", -F.col("score"))
    branches = scan.row_number(written(branches, "branches"), ["tree"], ["worse", "leaf"], "rank").drop("worse")
    if best is not None:
        branches = branches.where(F.col("rank") <= best)
    return spread_join(found, written(branches, "ranked"), ["tree", "leaf"])


def formatted(messages: DataFrame, best: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """tree, leaf, rank, score, segment, text, starts, ends (the loss mask) of the best paths of each tree, or of all."""
    messages = written(messages.select("tree", "message", "parent", "role", "text", "score"), "messages")
    chosen = ranked(paths(messages), messages, best)
    sizes = chosen.groupBy("tree", "leaf").agg(F.max("up").alias("_longest"))
    placed = spread_join(chosen, sizes, ["tree", "leaf"]).withColumn("place", F.col("_longest") - F.col("up"))
    placed = placed.select("tree", "leaf", "rank", F.col("score").alias("_score"), "message", "place", F.floor(F.col("place") / segment).alias("segment"))
    told = spread_join(placed, messages.select("tree", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "message"])
    kind = messages.schema["tree"].dataType.simpleString()
    number = messages.schema["message"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by path and place: a segment is done when the next one begins."""
        names = ["tree", "leaf", "rank", "score", "segment", "text", "starts", "ends"]
        key, first, parts, starts, ends, at = None, None, [], [], [], 0

        def done() -> pa.RecordBatch:
            fixed = [first.column(c) for c in ("tree", "leaf", "rank", "_score", "segment")]
            return pa.RecordBatch.from_arrays([*fixed, pa.array(["".join(parts)], pa.string()), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))], names)

        for batch in batches:
            keys = list(zip(batch.column("tree").to_pylist(), batch.column("leaf").to_pylist(), batch.column("segment").to_pylist(), strict=True))
            for i, (own, role, text) in enumerate(zip(keys, batch.column("role"), batch.column("text"), strict=True)):
                if own != key:
                    if first is not None:
                        yield done()
                    key, first, parts, starts, ends, at = own, batch.slice(i, 1), [], [], [], 0
                role = role.as_py()
                shown, a, b = turn(role, text.as_py())
                if role == LEARNED:
                    starts.append(at + a)
                    ends.append(at + b)
                parts.append(shown)
                at += len(shown)
        if first is not None:
            yield done()

    dealt = told.repartition("tree", "leaf", "segment").sortWithinPartitions("tree", "leaf", "segment", "place")
    return dealt.mapInArrow(write, f"tree {kind}, leaf {number}, rank bigint, score double, segment bigint, text string, starts array<bigint>, ends array<bigint>")


def read_back(texts: DataFrame) -> DataFrame:
    """tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, from their texts and masks."""
    kind, number = (texts.schema[c].dataType.simpleString() for c in ("tree", "leaf"))
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: what is held of a conversation is two running digests and three counts."""
        key, first, held = None, None, None

        def done() -> pa.RecordBatch:
            n, every, loss_chars, loss, size = held
            values = [pa.array([v], t) for v, t in ((n, pa.int64()), (every.hexdigest(), pa.string()), (loss_chars, pa.int64()), (loss.hexdigest(), pa.string()), (size, pa.int64()))]
            return pa.RecordBatch.from_arrays([first.column("tree"), first.column("leaf"), *values], ["tree", "leaf", *names])

        for batch in batches:
            keys = zip(batch.column("tree").to_pylist(), batch.column("leaf").to_pylist(), strict=True)
            for i, (own, text, starts, ends) in enumerate(zip(keys, batch.column("text"), batch.column("starts"), batch.column("ends"), strict=True)):
                if own != key:
                    if first is not None:
                        yield done()
                    key, first, held = own, batch.slice(i, 1), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = text.as_py()
                for role, said in turns(text):
                    held[0] += 1
                    held[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts.as_py(), ends.as_py(), strict=True):
                    said = unescaped(text[a:b])
                    held[2] += len(said)
                    held[3].update(said.encode())
                held[4] += len(text)
        if first is not None:
            yield done()

    ordered = texts.select("tree", "leaf", "segment", "text", "starts", "ends").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "segment")
    return ordered.mapInArrow(read, f"tree {kind}, leaf {number}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    texts = written(formatted(chain(rows.unionByName(added)), best=1), "chats")
    return read_back(texts).select(F.col("tree.of").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _extra(column: str) -> str:
    """SQL: how many backslashes escaping adds."""
    counted = [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS)]
    return " + ".join(counted)


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, length(role) + length(text) + {len(START) + len(END) + 2} + {_extra("role")} + length(role) - length(replace(role, chr(10), '')) + {_extra("text")} AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars FROM c GROUP BY conv_id
"""
