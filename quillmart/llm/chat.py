"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
Turns after the last assistant turn (all turns, where there is none) would be in no example, so they end one more
example without a target. A conversation's output therefore holds all of its turns.

A turn is ``<turn:ROLE>``, a line end, the text and ``</s>`` with a line end. In roles and texts ``&``, ``<``, ``>``
and ``[`` become ``&amp; &lt; &gt; &#91;`` (in roles also line ends ``&#10;``), so no text can hold ``</s>``,
``[INST]`` or a turn's mark; undoing the four in the opposite order gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is escaped, in order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"))
OPEN, CLOSE = "<turn:", "</s>\n"
TARGET = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """``(conv_id, example, target, formatted, loss_start, loss_chars)`` from ``(conv_id, turn, role, text)``.

    ``example`` numbers a conversation's examples in order of their last turns. ``target`` says whether the last turn is
    trainable; then ``loss_start`` and ``loss_chars`` are the code points of its escaped text in ``formatted``, else both
    are 0. Turns are ordered by turn, then role and text; repeated rows stay, a null text or role counts as empty, null
    turn numbers come first, a null conv_id is a conversation.

    The examples of a conversation grow with the square of its turns, which is the format; turns are grouped by
    conversation, so one conversation has to fit into a task.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("&#10;")), F.lit(">\n"))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))).alias("marked"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == TARGET) | (i == F.size("turns")))
    each = grouped.select("conv_id", "turns", "marked", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("turns", F.col("end"))
    before = F.array_join(F.slice("marked", F.lit(1), F.col("end") - 1), "")
    target = last["role"] == TARGET
    return each.select(
        "conv_id",
        "example",
        target.alias("target"),
        F.concat(before, F.element_at("marked", F.col("end"))).alias("formatted"),
        F.when(target, F.length(before) + F.length(last["head"])).otherwise(0).alias("loss_start"),
        F.when(target, F.length(last["body"])).otherwise(0).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted example."""
    parts = F.split(formatted, CLOSE, -1)
    marked = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def parse(m: Column) -> Column:
        role = F.substring_index(m, ">\n", 1)
        text = F.substring(m, F.length(role) + 3, F.length(m))
        name = F.substring(role, F.lit(len(OPEN) + 1), F.length(role))
        return F.struct(unescape(F.replace(name, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(marked, parse)


def digest(formatted: DataFrame) -> DataFrame:
    """What a conversation's examples hold, read back from them alone.

    ``n_turns`` and ``turns_sha256`` are of its last example, which ends with its last turn; ``loss_chars`` and
    ``loss_sha256`` of the text under the masks of all examples in order; ``formatted_chars`` of all examples together.
    """
    loss = F.when(F.col("target"), unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))))
    turns = read_turns(F.col("formatted"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.select("conv_id", "example", loss.alias("loss"), F.length("formatted").cast("long").alias("chars"), F.size(turns).cast("long").alias("n"), F.sha2(spoken, 256).alias("sha"))
    lost = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: F.coalesce(x["loss"], F.lit(""))), "")
    grouped = rows.groupBy("conv_id").agg(F.max(F.struct("example", "n", "sha")).alias("last"), lost.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return grouped.select(
        "conv_id",
        F.col("last.n").alias("n_turns"),
        F.col("last.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: op7 in DuckDB, with the template written out. The constants are those of this module.
ORACLE_SQL = """
WITH a AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n
      FROM a),
c AS (SELECT *, length('<turn:' || replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;'), chr(10), '&#10;')
                || '>' || chr(10) || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;') || '</s>' || chr(10)) AS chars
      FROM t),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
