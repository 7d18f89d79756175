"""Preference formatting of chosen and rejected conversations, on the JVM only.

The longest common turn prefix of the two conversations of a pair is rendered
once as the prompt; the turns after it become the two completions. A
completion comes with the character spans that are trained on: the text and
end mark of its assistant turns. All else, headers and other roles, is masked.

A conversation is one training example and so one row. Turns are gathered by
one grouping, partial on the map side.

Defined results: turns go by turn, then role, then text, nulls first, repeated
rows kept; a null role or text reads as empty; a pair of which one side is
missing has an empty conversation there; equal conversations have two empty
completions; rows with a null conversation id form no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, MIDDLE, CLOSE, END = "<|", "|>\n", "<|end|>", "\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: array of (turn, role, text) in order, from a row for each turn."""
    whole = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(whole)).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two turn arrays, by role and text."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    return let(same, lambda s: F.when(F.array_position(s, False) > 0, F.array_position(s, False) - 1).otherwise(F.size(s))).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def rendered(turn: Column) -> Column:
    return F.concat(_head(turn), turn["text"], F.lit(CLOSE + END))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_spans(turns: Column) -> Column:
    """(start, end) character offsets, in the rendered turns, of what is trained on."""
    size = lambda t: F.char_length(rendered(t))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + F.char_length(_head(turn))
        span = F.struct(first.alias("start"), (first + F.char_length(turn["text"]) + len(CLOSE)).alias("end"))
        spans = F.when(turn["role"] == TRAINED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size(turn)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def formatted(pairs: DataFrame) -> DataFrame:
    """Adds n_prompt_turns, prompt, chosen_text, rejected_text, chosen_spans and rejected_spans to rows with turn arrays `chosen` and `rejected`."""
    none = F.array().cast(pairs.schema["chosen"].dataType)
    rows = pairs.withColumns({"chosen": F.coalesce("chosen", none), "rejected": F.coalesce("rejected", none)})
    rows = rows.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda name: F.slice(name, F.col("n_prompt_turns") + 1, F.size(name))
    return rows.withColumns(
        {
            "prompt": text_of(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))),
            "chosen_text": text_of(rest("chosen")),
            "rejected_text": text_of(rest("rejected")),
            "chosen_spans": trained_spans(rest("chosen")),
            "rejected_spans": trained_spans(rest("rejected")),
        }
    )


def paired_with_next(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: conv_id, chosen, rejected.

    chosen is the conversation. rejected has the same turns up to its last
    assistant turn and, in place of that and what follows, the last assistant
    turn of conversation conv_id + 1 (an empty one if there is none). A
    conversation without an assistant turn is rejected in favour of itself
    with that turn added.
    """
    convs = conversations(turns)
    replies = lambda t: F.filter(t, lambda x: x["role"] == TRAINED)
    # Only the last replies meet their partners, not the conversations.
    last = convs.select((F.col("conv_id") - 1).alias("conv_id"), F.get(F.transform(replies(F.col("turns")), lambda x: x["text"]), F.size(replies(F.col("turns"))) - 1).alias("other"))
    rows = convs.join(last, "conv_id", "left")
    cut = F.aggregate(F.transform("turns", lambda x, i: F.when(x["role"] == TRAINED, i)), F.size("turns"), lambda a, i: F.coalesce(i, a))
    kind = convs.schema["turns"].dataType.elementType
    stand_in = F.struct(F.lit(None).cast(kind["turn"].dataType).alias("turn"), F.lit(TRAINED).alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    return rows.select("conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), cut), F.array(stand_in)).alias("rejected"))


def digests(pairs: DataFrame) -> DataFrame:
    """Per pair: conv_id, n_prompt_turns, hex SHA-256 of prompt and completions, and the trained characters of each completion."""
    rows = formatted(pairs)
    sha = lambda name: F.sha2(F.col(name), 256)
    trained = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select(
        "conv_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        sha("prompt").alias("prompt_sha256"),
        sha("chosen_text").alias("chosen_sha256"),
        sha("rejected_text").alias("rejected_sha256"),
        trained("chosen_spans").alias("chosen_trained"),
        trained("rejected_spans").alias("rejected_trained"),
    )


#: DuckDB SQL for digests(paired_with_next(conversations)).
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, max(CASE WHEN role = 'assistant' THEN pos END) AS cut, arg_max(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN pos END) AS reply FROM t GROUP BY conv_id),
p AS (SELECT c.conv_id, c.n, coalesce(c.cut, c.n + 1) AS cut, coalesce(o.reply, '') AS other FROM c LEFT JOIN c o ON o.conv_id = c.conv_id + 1),
k AS (SELECT p.*, CASE WHEN t.text IS NOT NULL AND t.role = 'assistant' AND t.text = p.other THEN p.cut ELSE p.cut - 1 END AS shared FROM p LEFT JOIN t ON t.conv_id = p.conv_id AND t.pos = p.cut),
r AS (
  SELECT k.conv_id, any_value(k.shared) AS shared, any_value(k.cut) AS cut, any_value(k.other) AS other,
         coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (pos <= k.shared), '') AS prompt,
         coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (pos > k.shared), '') AS chosen,
         coalesce(sum(length(text) + 7) FILTER (pos > k.shared AND role = 'assistant'), 0) AS trained
  FROM k JOIN t USING (conv_id) GROUP BY k.conv_id)
SELECT conv_id, CAST(shared AS BIGINT) AS n_prompt_turns, sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256,
       sha256(CASE WHEN shared >= cut THEN '' ELSE '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) END) AS rejected_sha256,
       CAST(trained AS BIGINT) AS chosen_trained, CAST(CASE WHEN shared >= cut THEN 0 ELSE length(other) + 7 END AS BIGINT) AS rejected_trained
FROM r
"""
