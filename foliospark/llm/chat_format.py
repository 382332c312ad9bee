"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its text is
trainable. A conversation that does not end with an assistant turn also gives one example without a trainable
span, so that no turn is lost.

Template: ``<|turn|>role NEWLINE text <|end|> NEWLINE`` for each turn. Inside roles and texts each control
string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets a backslash after its first character, and one
that already has backslashes there gets one more, so the escape can be undone exactly. In roles, ``%`` and line
ends are percent-encoded first, since a line end closes the role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Examples: ``conv_id, example, is_last, formatted, loss_start, loss_chars`` (a span in code points).

    ``example`` is the index of the example's last turn. Turns are ordered by turn number, then role and text (a
    null number comes first). Null roles and texts count as empty; rows with a null conversation id form one
    conversation. Repeated rows are turns like any other. An empty table gives no examples, and other columns are
    not read. The expansion writes every prefix, so its output grows with the square of the turns of a single
    conversation, never with the number of conversations; one conversation is formatted in one row. Texts of any
    length are formatted whole, as far as a conversation's prefixes fit in one task.
    """
    turns = (
        df.select(
            F.col(conv_col).alias("conv_id"),
            F.struct(
                F.col(turn_col).alias("turn"),
                F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.transform(
                "turns",
                lambda t: F.struct(
                    (t["role"] == "assistant").alias("reply"),
                    F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
                    escape(t["text"]).alias("body"),
                ),
            ).alias("turns"),
        )
    )
    n = F.size("turns")
    wanted = F.filter(
        F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["reply"] | (i == n)
    )
    rendered = F.transform(
        F.slice("turns", 1, F.col("i") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
    )
    last = F.element_at("turns", F.col("i"))
    return (
        turns.select("conv_id", "turns", F.explode(wanted).alias("i"))
        .select(
            "conv_id",
            (F.col("i") - 1).alias("example"),
            (F.col("i") == n).alias("is_last"),
            F.concat(F.array_join(rendered, ""), last["head"]).alias("before"),
            last["body"].alias("body"),
            last["reply"].alias("reply"),
        )
        .select(
            "conv_id",
            "example",
            "is_last",
            F.concat("before", "body", F.lit(CLOSE)).alias("formatted"),
            F.char_length("before").alias("loss_start"),
            F.when(F.col("reply"), F.char_length("body")).otherwise(0).alias("loss_chars"),
        )
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: its turns as parsed from the text of its last example, and the text under the loss masks."""
    per_conv = (
        examples.select(
            "conv_id",
            F.struct(
                "example", unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)")).alias("loss")
            ).alias("part"),
            F.when(F.col("is_last"), F.col("formatted")).alias("full"),
            F.char_length("formatted").cast("long").alias("chars"),
        )
        .groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list("part")).alias("parts"),
            F.max("full").alias("full"),
            F.sum("chars").alias("formatted_chars"),
        )
    )
    pieces = F.split("full", r"<\|turn\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def parsed(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(
            piece, F.char_length(role) + 2, F.char_length(piece) - F.char_length(role) - 1 - len(CLOSE)
        )
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return per_conv.select(
        "conv_id",
        F.transform(pieces, parsed).alias("turns"),
        F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss_text"),
        "formatted_chars",
    )


def op2_chat_format(spark, sf_dir):
    from .common import table

    extra = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_chats(chats)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
         length('<|turn|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'),
                '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || chr(10)
             || regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|end|>' || chr(10)) AS len
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
