r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation is its turns one after another, by turn number:

    <s>[INST] text [/INST]</s>                  a user's turn
    <s>[ROLE=name] text [/ROLE=name]</s>        any other role's turn

`<s>`, `</s>`, `[INST`, `[/INST`, `[ROLE=` and `[/ROLE=` are control strings. The escape puts a backslash before each
backslash, `<`, `[` and `]`. A deterministic parser cuts the output at each `</s>` without a backslash before it, reads the role up to the first `]` that
no backslash stands before, takes what lies between the two marks as the text and refuses control strings in it. Each
turn is first rendered as it is and parsed again; if what comes back differs, its text is escaped. The whole
conversation is then parsed and compared; if it still differs, all its texts are escaped. Role names are always escaped.

Defined cases: null texts and roles count as empty; a null turn comes first; ties of the turn go by role, then text;
repeated rows are turns of their own; rows with a null conv_id form one conversation of that id; an empty table gives
no rows; other columns are ignored, whatever their names. A conversation is one row, so its whole text is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</s>"
CONTROL = r"(?<!\\)(?:</?s>|\[/?(?:INST|ROLE=))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<\[\]])", "$1")


def role_mark(role: Column) -> Column:
    return F.when(role == "user", F.lit("INST")).otherwise(F.concat(F.lit("ROLE="), escaped(role)))


def rendered(mark: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>["), mark, F.lit("] "), text, F.lit(" [/"), mark, F.lit("]"))


def parsed_turn(piece: Column) -> Column:
    """(role, text) of a turn without its end mark; null where the grammar refuses it."""
    mark = F.regexp_extract(piece, r"(?s)^<s>\[([^\]\\]*(?:\\.[^\]\\]*)*)\] ", 1)
    size = F.char_length(mark)
    text = F.substring(piece, size + F.lit(7), F.char_length(piece) - size * 2 - F.lit(10))
    role = F.when(mark == "INST", F.lit("user")).when(mark.startswith("ROLE="), unescaped(F.substring(mark, F.lit(6), size)))
    sound = role.isNotNull() & piece.endswith(F.concat(F.lit(" [/"), mark, F.lit("]"))) & ~text.rlike(CONTROL)
    return F.when(sound, F.struct(role.alias("role"), unescaped(text).alias("text")))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.split(formatted, r"(?<!\\)" + END, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parsed_turn)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: the id, `formatted`, `turns` read back from it, `loss_spans` (code points of `formatted`, end
    exclusive, each over one assistant text as it stands there) and `identical`, whether the round trip holds."""
    source = turns.select(F.col(conv_col), F.col(turn_col).alias("_turn"), F.coalesce(role_col, F.lit("")).alias("_role"), F.coalesce(text_col, F.lit("")).alias("_text"))
    mark, text = F.col("_mark"), F.col("_text")
    back = parsed_turn(rendered(mark, text))
    turn = source.withColumn("_mark", role_mark(F.col("_role"))).withColumn("_fits", F.coalesce((back["text"] == text) & (back["role"] == F.col("_role")), F.lit(False)))
    turn = turn.withColumn("_full", escaped(text)).withColumn("_body", F.when(F.col("_fits"), text).otherwise(F.col("_full")))
    in_order = Window.partitionBy(conv_col).orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    around = F.char_length("_mark") * 2 + 14

    def start(body: str) -> Column:
        """Where the text begins: after the turns before it, and its own opening mark."""
        return F.coalesce(F.sum(around + F.char_length(body)).over(in_order), F.lit(0)) + F.char_length("_mark") + 6

    turn = turn.withColumn("_at", start("_body")).withColumn("_full_at", start("_full"))
    rows = turn.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct("_at", "_full_at", "_role", "_text", "_mark", "_body", "_full"))).alias("_rows"))

    def whole(body: str) -> Column:
        return F.array_join(F.transform("_rows", lambda r: F.concat(rendered(r["_mark"], r[body]), F.lit(END))), "")

    def spans(at: str, body: str) -> Column:
        return F.transform(F.filter("_rows", lambda r: r["_role"] == "assistant"), lambda r: F.struct(r[at].alias("start"), (r[at] + F.char_length(r[body])).alias("end")))

    wanted = F.transform("_rows", lambda r: F.struct(r["_role"].alias("role"), r["_text"].alias("text")))
    first = rows.withColumn("_wanted", wanted).withColumn("_first", whole("_body")).withColumn("_holds", F.coalesce(parsed(F.col("_first")) == F.col("_wanted"), F.lit(False)))
    return (
        first.withColumn("formatted", F.when(F.col("_holds"), F.col("_first")).otherwise(whole("_full")))
        .withColumn("loss_spans", F.when(F.col("_holds"), spans("_at", "_body")).otherwise(spans("_full_at", "_full")))
        .withColumn("turns", parsed(F.col("formatted")))
        .select(conv_col, "formatted", "turns", "loss_spans", F.coalesce(F.col("turns") == F.col("_wanted"), F.lit(False)).alias("identical"))
    )


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """What lies under the loss mask, unescaped: each span of the formatted text, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
