r"""Chat formatting with Spark expressions only.

A conversation becomes `<s>` and a block per run of turns of one role:
`[INST]role[/INST]text[NEXT]text</s>`. Control strings inside a text or a role get one
backslash after their first character (and one more if they have some already), so none
is left and unescaping is exact. Under the loss mask, a list of runs of characters,
stands the text of assistant turns.

Defined results: null text or role is empty; turns are ordered by (turn, role, text), so
ties and repeated rows have one order and all stay; a null conversation id is a
conversation of its own; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|NEXT\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|NEXT\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs (array<struct<n_chars,in_loss>>), from (conv_id, turn, role, text).

    The turns of a conversation are collected once, by the method's nature; a row is one
    conversation, however long."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            opens = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])  # else it is merged into the block before
            closes = (i + 1 >= F.size(t)) | (F.get(t, i + 1)["role"] != x["role"])
            head = F.concat(F.when(i == 0, "<s>").otherwise(""), F.when(opens, F.concat(F.lit("[INST]"), escape(x["role"]), F.lit("[/INST]"))).otherwise("[NEXT]"))
            return F.array(
                F.struct(head.alias("s"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"]).alias("s"), (x["role"] == LOSS_ROLE).alias("loss")),
                F.struct(F.when(closes, "</s>").otherwise("").alias("s"), F.lit(False).alias("loss")),
            )

        return F.flatten(F.transform(t, one))

    made = turns.select("conv_id", pieces(F.col("turns")).alias("pieces"))
    return made.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["s"]).cast("long").alias("n_chars"), p["loss"].alias("in_loss"))).alias("loss_runs"),
    )


def read_back(formatted: Column) -> Column:
    """The turns, array<struct<role,text>>, from the formatted string alone."""
    blocks = F.split(F.substr(formatted, F.lit(4)), "</s>")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(7)), r"\[/INST\]")
        return F.transform(F.split(F.get(parts, 1), r"\[NEXT\]"), lambda t: F.struct(unescape(F.get(parts, 0)).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss_runs: Column) -> Column:
    """All text under the mask, unescaped; a mask that is not of this string is an error. The mask's runs of text lie between control strings in the order of the string."""
    between = F.split(formatted, r"<s>|</s>|\[/?INST\]|\[NEXT\]")
    # A turn's three runs (head, text, tail) lie at 3k, 3k+1, 3k+2; the string's pieces between control strings
    # hold nothing, roles and texts, the texts being those after [/INST] or [NEXT].
    before = F.concat(F.array(F.lit("")), F.regexp_extract_all(formatted, F.lit(r"<s>|</s>|\[/?INST\]|\[NEXT\]"), 0))
    texts = F.filter(F.arrays_zip(before.alias("b"), between.alias("t")), lambda x: x["b"].isin("[/INST]", "[NEXT]"))
    runs = F.filter(loss_runs, lambda r, i: i % 3 == 1)
    disagree = F.raise_error(F.lit("the loss mask is not of this string")).cast("string")
    taken = F.zip_with(texts, runs, lambda t, r: F.when(t["t"].isNull() | r.isNull() | (F.length(t["t"]) != r["n_chars"]), disagree).when(r["in_loss"], unescape(t["t"])).otherwise(""))
    return F.array_join(taken, "")


def digest(formatted: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted and loss_runs."""
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def check_conversation(rows: DataFrame) -> DataFrame:
    """Conversation -7: two turns that consist of control strings."""
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    return rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text)


ORACLE = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM a),
c AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS opens,
        length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|NEXT\])', '\1\\\2\3', 'g')) AS te,
        length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|NEXT\])', '\1\\\2\3', 'g')) AS re FROM b)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(te + CASE WHEN opens THEN re + 17 ELSE 6 END))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
