"""Chat formatting by prefix-target expansion: every assistant turn becomes its own example, with all
turns before it as context and only that reply trainable. DataFrame functions only.

Template of a turn: ``<|im_start|>role<|sep|>text<|im_end|>``. Roles and texts are escaped so that
no control string of this or other common templates survives inside them: each backslash is
doubled, and a backslash is put after the first character of each control string.
``unescape`` removes exactly those backslashes.

A conversation that doesn't end with an assistant turn also yields one closing example without a
trainable reply, so that no turn is lost from the output.

Nulls and odd rows: null text and null role count as empty; rows with a null conversation id form one
conversation; turns sort by (turn, role, text), nulls first, so ties and repeated rows keep a defined
order and all of them stay; an empty table gives no example. Other input columns are ignored, so
clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table

START, SEP, END = "<|im_start|>", "<|sep|>", "<|im_end|>"
#: Prefixes or whole control strings that must not survive inside a text (fixed values).
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (0, 1, ...), is_last, text, loss_start and loss_length
    (code points of the trainable span in text; 0, 0 where there is none).

    One shuffle by conversation; the examples are expanded row by row from the sorted turns, so
    a conversation's prefixes are never held together.
    """
    part = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.select(F.col(conv_id).alias("conv_id"), part.alias("part")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("part")).alias("parts"))
    rendered = grouped.select("conv_id", F.transform("parts", lambda p: F.struct(
        (p["role"] == target_role).alias("target"),
        F.concat(F.lit(START), escape(p["role"]), F.lit(SEP)).alias("head"),
        escape(p["text"]).alias("body"))).alias("turns"))
    closing = F.size("turns") - 1
    picks = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("at"), t["target"].alias("target"))),
                     lambda p: p["target"] | (p["at"] == closing))
    picked = rendered.select("conv_id", "turns", picks.alias("picks"))
    each = picked.select("conv_id", "turns", F.size("picks").alias("n"), F.posexplode("picks").alias("example", "pick"))
    whole = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("pick.at") + 1),
                                     lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    reply = F.element_at("turns", F.col("pick.at") + 1)["body"]
    loss = F.when(F.col("pick.target"), F.length(reply)).otherwise(0)
    made = each.select("conv_id", "example", (F.col("example") + 1 == F.col("n")).alias("is_last"),
                       whole.alias("text"), loss.alias("loss_length"), F.col("pick.target").alias("target"))
    # the reply ends the text, before the end mark: its start follows from the lengths
    start = F.when(F.col("target"), F.length("text") - len(END) - F.col("loss_length")).otherwise(0)
    return made.select("conv_id", "example", "is_last", "text", start.alias("loss_start"), "loss_length")


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from an example's text."""
    pieces = F.slice(F.split(text, r"<\|im_end\|>"), 1, F.size(F.split(text, r"<\|im_end\|>")) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), SEP, 1)).alias("role"),
        unescape(F.substring_index(p, SEP, -1)).alias("text")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, everything read back from the formatted examples."""
    loss = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_length")))
    last = F.when(F.col("is_last"), read_turns(F.col("text")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select("conv_id", "example", F.length("text").cast("bigint").alias("chars"),
                           loss.alias("loss"), last.alias("turns"))
    read = read.select("conv_id", "example", "chars", "loss", F.size("turns").cast("bigint").alias("n"),
                       F.when(F.col("turns").isNotNull(), F.sha2(flat, 256)).alias("turns_sha256"))
    per = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"))
    joined = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return per.select("conv_id", "n_turns", "turns_sha256", F.length(joined).cast("bigint").alias("loss_chars"),
                      F.sha2(joined, 256).alias("loss_sha256"), "formatted_chars")


def op2_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, plus conversation -1 (control strings in its texts), formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return conversation_digests(format_examples(turns.unionByName(extra)))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum({len(START) + len(SEP) + len(END)} + length({_sql_escape('role')}) + length({_sql_escape('text')})) OVER o AS prefix
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
