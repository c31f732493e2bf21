"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A turn is written as <|turn:ROLE|>, a line feed, its text, <|end|>, a line feed. In roles and texts every backslash is
doubled and a backslash is put after the first character of each control string (of this template and of others in
wide use), so no control string is left in them; reading back undoes both steps exactly.

Every assistant turn becomes an example: all turns before it as context, and only that reply's text in the loss span.
Turns after the last reply would be in no example, so a conversation that does not end in a reply gets a last example
of all its turns with an empty loss span.

Nulls: a null text or role is an empty one; rows with a null conv_id are one conversation; null turns come first.
Order within a conversation: turn, then role, then text, so ties and repeated rows have a defined place. Empty tables
give empty results. Columns other than conv_id, turn, role and text are not read. A conversation is gathered in one
row, as its last example holds all of it anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = "assistant"
_CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\|(?=>))"
_OPEN, _SHUT, _END = "<|turn:", "|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[|])\\(?!\\)", "$1"), F.lit("\\\\"), F.lit("\\"))


def examples(conversations: DataFrame, target: str = TARGET) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end (code points of text; equal where nothing is trained)."""
    role, said = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    head, body = F.concat(F.lit(_OPEN), escaped(role), F.lit(_SHUT)), escaped(said)
    turn = F.struct(F.col("turn"), role.alias("role"), said.alias("said"), head.alias("head"), body.alias("body"))
    talks = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    places = F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == target, i))
    places = F.filter(places, lambda i: i.isNotNull())
    last = F.size("turns") - 1
    places = F.when(F.element_at("turns", -1)["role"] == target, places).otherwise(F.concat(places, F.array(last)))
    cut = talks.select("conv_id", "turns", F.posexplode(places).alias("example", "place"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("place")), lambda t: F.concat(t["head"], t["body"], F.lit(_END))), "")
    own = F.get("turns", F.col("place"))
    start = F.concat(before, own["head"])
    trained = own["role"] == target
    made = cut.select("conv_id", "example", F.concat(start, own["body"], F.lit(_END)).alias("text"), F.char_length(start).alias("start"), F.char_length(own["body"]).alias("length"), trained.alias("trained"))
    total = F.char_length("text")
    return made.select("conv_id", "example", "text", F.when(F.col("trained"), F.col("start")).otherwise(total).alias("loss_start"), F.when(F.col("trained"), F.col("start") + F.col("length")).otherwise(total).alias("loss_end"))


def turns_of(text: Column) -> Column:
    """Roles and texts read back from an example's text: an array of structs."""
    pieces = F.split(text, r"<\|end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def read(piece: Column) -> Column:
        head = F.substring_index(piece, _SHUT, 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(len(_OPEN) + 1))).alias("role"),
            unescaped(F.substr(piece, F.char_length(head) + F.lit(len(_SHUT) + 1))).alias("text"),
        )

    return F.transform(pieces, read)


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the examples alone."""
    loss = unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    talks = made.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"), F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"), F.sum(F.char_length("text").cast("long")).alias("formatted_chars")
    )
    talks = talks.select("conv_id", "formatted_chars", turns_of(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


#: The same for the query's rows in DuckDB's SQL: escapes lengthen a text by its backslashes and control strings.
SQL = r"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), lengths AS (
  SELECT *, length(role) + length(said) + 18 + (length(role || said) - length(replace(role || said, '\', '')))
      + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]|\|>')) + len(regexp_extract_all(said, '<\||</?s>|<</?SYS>>|\[/?INST\]|\|>')) AS chars
  FROM spoken
), placed AS (
  SELECT *, sum(chars) OVER upto AS through, row_number() OVER upto = count(*) OVER (PARTITION BY conv_id) AS is_last
  FROM lengths WINDOW upto AS (PARTITION BY conv_id ORDER BY turn, role, said ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
       coalesce(sum(length(said)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(through) FILTER (role = 'assistant' OR is_last))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""
