"""Chat formatting over reply trees, with DataFrame functions only.

A message has a tree, a node id, a parent node (null at a root) and a score. Iterative
self-joins with doubled steps give each leaf its whole path score in about log2(depth)
rounds; the best path of every tree is then expanded through the same jump tables and
formatted as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import any_row, durable, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What must not appear inside a text as it stands: the template's own marks and those of common chat formats.
_CONTROL = r"(\|(?:turn|text|end|im_start|im_end|endoftext|startoftext)\|>|/?s>|/?INST\]|<?/?SYS>>)"
_PLAIN = r"([<\[])(\\*)" + _CONTROL
_ESCAPED = r"([<\[])\\(\\*)" + _CONTROL


def escape(text: Column) -> Column:
    """One backslash is added after the first character of a control string, whatever number is there already."""
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def best_paths(messages: DataFrame) -> DataFrame:
    """The root-to-leaf path with the highest summed score of each tree: (tree, node, depth).

    ``messages``: tree, node, parent, score. A null score counts 0; a parent that is absent
    makes its child a root; ties go to the longer path, then to the smaller leaf id. Of rows
    with the same tree and node one counts. Messages on a parent cycle hang from no root and
    are left out. Null trees form one tree; rows with a null node are left out.
    """
    m = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    ids = m.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    m = m.join(ids, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    jump = durable(m.select("tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")))
    leaves = jump.select("tree", "node").join(
        jump.where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("n")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti"
    )
    jumps, most = [], None
    while any_row(active := jump.where("up IS NOT NULL")):
        jumps.append(active.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", "steps"))
        most = most or jump.count()
        if 2 ** len(jumps) > 2 * most:
            break
        over = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("steps").alias("s2"), F.col("total").alias("t2"))
        # What has arrived at a root is not joined again.
        further = active.join(over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("total") + F.col("t2")).alias("total")
        )
        jump = durable(further.unionByName(jump.where("up IS NULL")).repartition("tree", "node"))
    ends = jump.where("up IS NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), "steps", "total")
    ranked = leaves.join(ends, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    path = ranked.groupBy("tree").agg(F.max_by(F.struct("node", "steps"), F.struct("total", "steps", (-F.col("node")).alias("last"))).alias("b")).select("tree", "b.node", F.col("b.steps").alias("depth"))
    path = durable(path)
    for j in reversed(jumps):
        up = path.join(j, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", F.col("up").alias("node"), (F.col("depth") - F.col("steps")).alias("depth"))
        path = durable(path.unionByName(up).repartition("tree", "node"))  # else each round would double the plan
    return path


def format_paths(turns: DataFrame) -> DataFrame:
    """(tree, formatted, loss): one string per tree, and the spans of the assistant's texts.

    ``turns``: tree, depth, role, text. A null role or text is the empty string. ``loss`` has
    (start, chars) in code points of ``formatted``, from 0, in order.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head, body = F.concat(F.lit(TURN), role, F.lit(TEXT)), text
    rows = turns.select("tree", "depth", head.alias("head"), body.alias("body"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    by = Window.partitionBy("tree").orderBy("depth")
    rows = rows.withColumn("start", F.sum(F.length("piece")).over(by) - F.length("body") - F.lit(len(END)))
    span = F.when(F.col("learn"), F.struct(F.col("start"), F.length("body").alias("chars")))
    out = rows.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("depth", "piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("loss"))
    return out.select("tree", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, turns, learned, formatted): the turns and the text under the loss mask, from the formatted string alone."""
    parts = F.split("formatted", r"<\|turn\|>", -1)
    marks = F.slice(parts, F.lit(2), F.size(parts))
    one = lambda x: F.struct(
        unescape(F.substring_index(x, TEXT, 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(x, F.lit(r"^[\s\S]*?<\|text\|>"), F.lit("")), F.lit(r"<\|end\|>$"), F.lit(""))).alias("text"),
    )
    cut = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))))
    return formatted.select("tree", F.transform(marks, one).alias("turns"), F.array_join(cut, "").alias("learned"), "formatted")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Rows by turn as chains: each row replies to the row before it.

    Null turns come first; rows with the same turn follow each other by role and text, so
    repeated rows are repeated turns. Extra columns are dropped.
    """
    by = Window.partitionBy("tree").orderBy("turn", "role", "text")
    m = rows.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(by).cast("long"))
    return m.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_reply_trees(messages: DataFrame) -> DataFrame:
    """(tree, formatted, loss) of the best path of each tree; see ``best_paths`` and ``format_paths``."""
    chosen = best_paths(messages).select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    one = messages.where("node IS NOT NULL").dropDuplicates(["tree", "node"])
    turns = one.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "depth", "role", "text")
    return format_paths(turns)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, turn, role, :hard AS text FROM VALUES (CAST(0 AS BIGINT), 'user'), (CAST(1 AS BIGINT), 'assistant') AS t(turn, role)", args={"hard": hard})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_reply_trees(durable(conversation_messages(rows))))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|(?:turn|text|end|im_start|im_end|endoftext|startoftext)\|>|/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2\3', 'g') AS te,
    regexp_replace(role, '([<\[])(\\*)(\|(?:turn|text|end|im_start|im_end|endoftext|startoftext)\|>|/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2\3', 'g') AS re FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(te) + length(re) + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {"op9_chat_format": _ORACLE}
