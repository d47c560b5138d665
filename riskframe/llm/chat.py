"""Chat formatting whose output a deterministic parser reads back unchanged.

Grammar of a formatted conversation::

    conversation := "<s>" turn*
    turn         := "[INST]" role "[/INST]" body "</s>"

Roles and bodies hold no control string.  Every turn is first rendered as it
is and reparsed; a turn that does not come back identical is escaped and
checked again, and the whole conversation is parsed once more at the end.  An
escape puts one backslash after the first character of a control string (and
of one that already carries backslashes there), the parser takes one away, so
escaping is reversible for any text.

Only DataFrame functions are used.  Cases: a null text or role counts as empty;
rows are ordered by turn, then role and text, so ties and repeated rows have
one order (nulls first); a null conversation id is a conversation of its own;
an empty table gives an empty result; further columns are ignored.  The rows of
one conversation meet in one row, as its text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import col

BEGIN, TURN, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
ANY_CONTROL = r"</?s>|\[/?INST\]"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Put a backslash into every control string, also one escaped before."""
    out = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(out, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    out = F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2")
    return F.regexp_replace(out, r"\[\\(\\*)(/?INST\])", "[$1$2")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(BODY), body, F.lit(END))


def parse_piece(piece: Column) -> Column:
    """(role, text) of a turn without its end mark; null if it breaks the
    grammar."""
    at = F.instr(piece, BODY)
    role = F.substring(piece, F.lit(len(TURN) + 1), at - 1 - len(TURN))
    body = F.substring(piece, at + len(BODY), F.length(piece))
    fits = (F.startswith(piece, F.lit(TURN)) & (at > len(TURN))
            & ~role.rlike(ANY_CONTROL) & ~body.rlike(ANY_CONTROL))
    return F.when(fits, F.struct(unescape(role).alias("role"), unescape(body).alias("text")))


def parse_turns(turns: Column) -> Column:
    """Recovered turns of concatenated turns; null if the last has no end."""
    pieces = F.split(turns, END, -1)
    return F.when(F.element_at(pieces, -1) == "", F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_piece))


def parse_conversation(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation; null if it does not
    start with the begin mark."""
    return F.when(F.startswith(formatted, F.lit(BEGIN)),
                  parse_turns(F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))))


def format_conversations(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text",
                         loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans``
    (array of turn index and code point range [start, end) of every body that
    counts for the loss) and ``escaped_turns``.  Fails if a conversation does
    not survive the round trip."""
    source = F.struct(F.col("r").alias("role"), F.col("t").alias("text"))
    rows = convs.select(col(conv_id).alias("c"), col(turn).alias("n"),
                        F.coalesce(col(role).cast("string"), F.lit("")).alias("r"),
                        F.coalesce(col(text).cast("string"), F.lit("")).alias("t"))
    plain = render_turn(F.col("r"), F.col("t"))
    back = parse_turns(plain)
    rows = rows.withColumn("ok", F.coalesce(
        (F.size(back) == 1) & (back[0] == source), F.lit(False)))
    rows = rows.withColumn("er", F.when(F.col("ok"), F.col("r")).otherwise(escape(F.col("r"))))
    rows = rows.withColumn("eb", F.when(F.col("ok"), F.col("t")).otherwise(escape(F.col("t"))))
    in_order = Window.partitionBy("c").orderBy("n", "r", "t")
    head = F.length("er") + (len(TURN) + len(BODY))
    rows = (rows.withColumn("piece", render_turn(F.col("er"), F.col("eb")))
            .withColumn("k", F.row_number().over(in_order))
            .withColumn("end", F.lit(len(BEGIN)) + F.sum(F.length("piece").cast("long")).over(
                in_order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("start", F.col("end") - F.length("piece") + head))
    span = F.when(F.col("r") == loss_role, F.struct(
        (F.col("k") - 1).alias("turn"), F.col("start").alias("start"),
        (F.col("end") - len(END)).alias("end")))
    whole = (rows.groupBy("c").agg(
        F.array_sort(F.collect_list(F.struct("k", "piece", source.alias("source")))).alias("a"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
        F.count_if(~F.col("ok")).alias("escaped_turns"))
        .withColumn("formatted", F.concat(F.lit(BEGIN), F.array_join("a.piece", ""))))
    same = parse_conversation(F.col("formatted")) == F.col("a.source")
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("no round trip for conversation "), F.col("c").cast("string"))))
    return whole.select(F.col("c").alias(conv_id), checked.alias("formatted"), "loss_spans",
                        "escaped_turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text) parsed from the formatted text and ``loss_texts``,
    the bodies under the loss mask without escapes, in order."""
    pieces = F.split(F.substring(F.col("formatted"), F.lit(len(BEGIN) + 1),
                                 F.length("formatted")), END, -1)
    under = F.transform("loss_spans", lambda s: unescape(F.right(
        F.element_at(F.col("pieces"), (s["turn"] + 1).cast("int")), (s["end"] - s["start"]).cast("int"))))
    return (formatted.withColumn("turns", parse_conversation(F.col("formatted")))
            .withColumn("pieces", pieces).withColumn("loss_texts", under).drop("pieces"))
