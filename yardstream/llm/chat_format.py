"""Chat transcripts as text, checked by reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardstream.llm.common import let

# Fixed values of the template (ChatML marks) and the marks of other common templates, which may not stand bare in a text either.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_RESERVED = ["[|]im_start[|]>", "[|]im_end[|]>", "[|]endoftext[|]>", "/?s>", "/?INST\\]"]
_REST = "(" + "|".join(_RESERVED) + ")"
#: A mark, also with backslashes after its first character.
_MARK = r"([<\[])(\\*)" + _REST
_BARE, _QUOTED = r"[<\[]" + _REST, r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    """One more backslash inside every mark (``<|im_end|>`` -> ``<\\|im_end|>``)."""
    return F.regexp_replace(text, _MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, _QUOTED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role stands on one line: backslashes and line ends are written as ``\\\\`` and ``\\n``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pieces = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns of a transcript: array of (role, text, bare).

    Grammar: turn = OPEN role "\\n" text CLOSE.  ``bare`` tells that a control
    string stands unescaped inside the role or text, or that the turn does not
    follow the grammar; the deterministic reading is then not the source's.
    """
    head = "(?s)^" + r"<\|im_start\|>([^\n]*)\n(.*)$"
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    # What follows the last CLOSE is empty.
    turns = let(pieces, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: let(
        F.struct(F.regexp_extract(x, head, 1).alias("r"), F.regexp_extract(x, head, 2).alias("t"), x.rlike(head).alias("ok")),
        lambda y: F.struct(unescape_role(y["r"]).alias("role"), unescape(y["t"]).alias("text"), (~y["ok"] | y["r"].rlike(_BARE) | y["t"].rlike(_BARE)).alias("bare")))))
    return turns


def _same(parsed: Column, source: Column) -> Column:
    plain = F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return ~F.exists(parsed, lambda t: t["bare"]) & plain.eqNullSafe(source)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns, n_escaped, loss_turns, round_trip) for ``turns`` (conv_id, turn, role, text).

    Each turn is rendered as it is and read back; where role or text doesn't
    come back, that turn's content is escaped.  The transcript is read back once
    more as a whole: round_trip tells that the reading equals the source.
    Escaping is one to one and a turn ends in the only CLOSE it holds, so it does.

    loss_turns lists (index, start, end) of the assistant texts that training
    counts: turn index from 0, code points of ``formatted``, end exclusive.

    Turns stand in the order of ``turn`` (null first; ties by role, then text;
    repeated rows are turns of their own).  Null roles and texts count as empty,
    rows with a null conv_id are one conversation.  An empty table gives none.
    """
    source = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", "turn", source.alias("s"))
    plain, quoted = render(F.col("s.role"), F.col("s.text")), render(escape_role(F.col("s.role")), escape(F.col("s.text")))
    rows = rows.withColumn("fits", let(plain, lambda p: _same(parse(p), F.array("s"))))
    rows = rows.withColumn("line", F.when(F.col("fits"), plain).otherwise(quoted))
    # Where a turn starts is summed up before the turns are gathered.
    order = Window.partitionBy("conv_id").orderBy("turn", "s.role", "s.text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = F.length("line") - len(CLOSE)
    rows = rows.withColumns({"end": F.sum(F.length("line")).over(order), "nth": F.row_number().over(order) - 1})
    rows = rows.withColumn("head", F.length("line") - len(CLOSE) - F.when(F.col("fits"), F.length("s.text")).otherwise(F.length(escape(F.col("s.text")))))
    start = F.col("end") - F.length("line")
    loss = F.when(F.col("s.role") == "assistant", F.struct((start + F.col("head")).alias("start"), (start + body).alias("end")))
    rows = rows.select("conv_id", F.struct("nth", "line", "fits", "s", loss.alias("loss")).alias("x"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    chats = chats.select("conv_id", "x", F.transform("x", lambda x: x["s"]).alias("source"), F.array_join(F.transform("x", lambda x: x["line"]), "").alias("formatted"))
    loss_turns = F.transform(F.filter("x", lambda x: x["loss"].isNotNull()), lambda x: F.struct(x["nth"].alias("index"), x["loss"]["start"].alias("start"), x["loss"]["end"].alias("end")))
    return chats.select(
        "conv_id", "formatted", F.size("source").cast("long").alias("n_turns"),
        F.size(F.filter("x", lambda x: ~x["fits"])).cast("long").alias("n_escaped"), loss_turns.alias("loss_turns"),
        _same(parse(F.col("formatted")), F.col("source")).alias("round_trip"))


def read_back(chats: DataFrame) -> DataFrame:
    """What a reader of ``formatted`` and the loss mask finds, as digests."""
    turns = parse(F.col("formatted"))
    rows = chats.withColumn("turns", turns)
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(let(F.col("turns"), lambda ts: F.transform("loss_turns", lambda m: ts[m["index"]]["text"])), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped", "round_trip")
