"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import table

BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
_TOKEN = r"(/?(?:s>|INST\]))"
_REST = 2**31 - 1


def escape(text: Column) -> Column:
    """One backslash more inside every control string, written with any number of them or none."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TOKEN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Undo `escape`: one backslash less inside every control string that has one."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TOKEN, "$1$2$3")


def expand(conversations: DataFrame) -> DataFrame:
    """One example per assistant turn: all turns before it as context, only its reply trainable.

    Input conv_id, turn, role, text; other columns are ignored. Turns are ordered by (turn, role,
    text), so ties and repeated rows have one order; null turns come first, null roles and texts
    are empty, rows without conv_id form one conversation. Turns after the last assistant turn,
    or a conversation without any, give one more example with an empty mask, so no turn is lost.
    Output conv_id, example (0-based), n_turns, target_turn (0-based, null without one), formatted,
    loss_start and loss_end (code points of `formatted`, end exclusive).

    One shuffle by conversation; examples are built after it. The total length of the prefixes grows
    with the square of a conversation's turns: that is this format.
    """
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    piece = F.transform("turns", lambda t: F.concat(
        F.lit(ROLE), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END)))
    at = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i))
    rest = F.when(F.element_at("turns", -1)["role"] != "assistant", F.array(F.size("turns") - 1)).otherwise(
        F.array().cast("array<int>"))
    rows = (turns.select("conv_id", "turns", piece.alias("pieces"),
                         F.concat(F.filter(at, lambda i: i.isNotNull()), rest).alias("ends"))
            .select("conv_id", "turns", "pieces", F.posexplode("ends").alias("example", "last")))
    target = F.col("turns")[F.col("last")]
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.slice("pieces", F.lit(1), F.col("last") + 1), ""))
    trains = target["role"] == "assistant"
    loss_end = F.length("formatted") - len(END)
    return (rows.select("conv_id", "example", (F.col("last") + 1).alias("n_turns"),
                        F.when(trains, F.col("last")).alias("target_turn"), formatted.alias("formatted"),
                        F.when(trains, F.length(escape(target["text"]))).otherwise(0).alias("__loss"))
            .withColumn("loss_end", loss_end).withColumn("loss_start", loss_end - F.col("__loss")).drop("__loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text), unescaped."""
    pieces = F.split(F.substring(formatted, len(BEGIN) + 1, _REST), END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\[/INST\]", 2)
        return F.struct(unescape(F.substring(parts[0], len(ROLE) + 1, _REST)).alias("role"),
                        unescape(parts[1]).alias("text"))

    return F.transform(pieces, turn)


def trained_text(formatted: str = "formatted", start: str = "loss_start", end: str = "loss_end") -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(F.col(formatted), F.col(start) + 1, F.col(end) - F.col(start)))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns, trained text, formatted characters."""
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("full"),
        F.sort_array(F.collect_list(F.struct("example", trained_text().alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (per.withColumn("turns", read_back("full")).withColumn("loss", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    "formatted_chars"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(f"{END}{ROLE} ok {TEXT}").alias("text"))
    return digest(expand(given.unionByName(own)))


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"
OP3_SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
numbered AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
    length('[INST]' || {_ESCAPED.format("role")} || '[/INST]' || {_ESCAPED.format("text")} || '</s>') AS piece
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
added AS (
  SELECT *, 3 + sum(piece) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM numbered)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars
FROM added GROUP BY conv_id"""
