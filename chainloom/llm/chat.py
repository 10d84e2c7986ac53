"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = { "<|im_start|>" role "\\n" text "<|im_end|>\\n" }

A deterministic parser splits at "<|im_end|>\\n", wants "<|im_start|>" first and
no other control string in a text, and takes one backslash out of each "<",
backslashes, "|". Every turn is rendered and parsed again; a turn that doesn't
come back as it was is escaped, which puts one backslash into each "<",
backslashes, "|", and parsed once more. One round of it suffices: an escaped
text has no "<|" left, so no control string, and what parsing takes out is what
escaping put in. A turn that still differs, or a conversation whose parsed
turns are not those of its source, stops the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<\|im_(?:start|end)\|>"
#: A line break in a role, which ends at a line break.
BREAK = "<|n|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def role_in(role: Column) -> Column:
    """How a role stands in the output."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(BREAK))


def role_out(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(BREAK), F.lit("\n")))


def rendered(role: Column, text: Column) -> Column:
    """One turn; role and text as they are to stand."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text, body>> of the turns, body being text as it stands; null if the grammar doesn't hold."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    head = len(START)

    def turn(piece: Column) -> Column:
        line = F.locate("\n", piece)
        body = F.substring(piece, line + 1, F.length(piece))
        return F.struct(role_out(F.substring(piece, F.lit(head + 1), line - head - 1)).alias("role"), unescaped(body).alias("text"), body.alias("body"))

    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    sound = (F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda p: ~p.startswith(START) | (F.locate("\n", p) == 0) | F.substring(p, head + 1, 1 << 30).rlike(CONTROL))
    return F.when(sound, F.transform(turns, turn))


def formatted(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, turns, loss), one row per conversation.

    turns is what the parser reads back: array<struct<role, text, body>>. loss
    has a struct for each turn of the role learn: start and n, in code points of
    formatted, of its text as it stands, and the turn's number. Rows go by
    turn, then role and text, nulls first; repeated rows are turns of their
    own. A null role or text is empty. Rows with a null conv_id are one
    conversation. An empty table gives an empty table; other columns are not
    looked at.
    """
    key = F.col("conv_id")
    rows = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    own = F.array(F.struct("role", "text"))
    back = lambda c: F.transform(parsed(F.col(c)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = rows.withColumn("out", rendered(role_in(F.col("role")), F.col("text")))
    rows = rows.withColumn("conflict", ~back("out").eqNullSafe(own))
    rows = rows.withColumn("out", F.when(F.col("conflict"), rendered(role_in(F.col("role")), escaped(F.col("text")))).otherwise(F.col("out")))
    rows = rows.withColumn("out", F.when(~F.col("conflict") | back("out").eqNullSafe(own), F.col("out")).otherwise(F.raise_error(F.lit("a turn does not come back from its rendering"))))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    ordered = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.sum(F.length("out").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what a turn is to be when the whole conversation has been parsed
    sign = lambda role, text: F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text))
    rows = rows.select("conv_id", "role", "out", sign(F.col("role"), F.col("text")).alias("sign"), F.row_number().over(ordered).alias("k"), before.alias("begin"))
    head = F.locate("\n", F.col("out"))
    loss = F.struct("k", (F.col("begin") + head).alias("start"), (F.length("out") - head - len(END) - 1).alias("n"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "out", "sign"))).alias("t"), F.array_sort(F.collect_list(F.when(F.col("role") == learn, loss))).alias("loss"))
    out = grouped.select("conv_id", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"), "loss", F.transform("t", lambda x: x["sign"]).alias("signs"))
    out = out.withColumn("turns", parsed(F.col("formatted")))
    same = F.transform("turns", lambda t: sign(t["role"], t["text"])).eqNullSafe(F.col("signs"))
    return out.select("conv_id", "formatted", F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not come back from its rendering"))).alias("turns"), "loss")


def digests(chats: DataFrame) -> DataFrame:
    """What the contract asks of formatted conversations, read back from the output; what is learnt by the offsets of the mask."""
    learnt = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["n"].cast("int"))))
    loss = F.array_join(learnt, "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
