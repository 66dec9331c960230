"""Chat formatting: render turns by a grammar, parse the result back, escape until it is the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.llm.text import let

#: ``### role: text </turn>`` and a newline for each turn.
OPEN, SEP, CLOSE, END = "### ", ": ", "</turn>", "\n"


def escape(c: Column) -> Column:
    r"""Control strings broken up by a backslash, after every backslash was doubled."""
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(CLOSE), F.lit("<\\/turn>")), F.lit(OPEN), F.lit("#\\## "))


def unescape(c: Column) -> Column:
    r"""The inverse: doubled backslashes come in even runs, so ``<\/turn>`` and ``#\## `` are ours."""
    opened = F.replace(F.replace(c, F.lit("#\\## "), F.lit(OPEN)), F.lit("<\\/turn>"), F.lit(CLOSE))
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(SEP), F.lit(":\\ "))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(":\\ "), F.lit(SEP)))


def render(turns: Column, escaped_from: Column) -> Column:
    """One string; texts from turn number ``escaped_from`` on are escaped, earlier ones stand as they are."""
    # Names are bound by let, or an expression would be worked out again for every turn.
    def with_start(start: Column) -> Column:
        one = lambda t, i: F.concat(
            F.lit(OPEN),
            escape_role(t["role"]),
            F.lit(SEP),
            F.when(i >= start, escape(t["text"])).otherwise(t["text"]),
            F.lit(CLOSE + END),
        )
        return F.array_join(F.transform(turns, one), "")

    return let(escaped_from, with_start)


def bodies(rendered: Column) -> Column:
    """The turns of a rendered string as they stand in it: role, text.

    Deterministic: a turn ends at the first CLOSE, its role at the first SEP.
    What is left outside turns, and an OPEN inside a text, give a null text,
    which no source has.
    """

    def turn(inner: Column, cut: Column, text: Column, starts: Column) -> Column:
        fine = starts & (cut > 0) & ~F.contains(text, F.lit(OPEN))
        return F.struct(F.when(fine, F.substr(inner, F.lit(1), cut - 1)).alias("role"), F.when(fine, text).alias("text"))

    def one(s: Column, i: Column) -> Column:
        head = F.when(i > 0, F.lit(END + OPEN)).otherwise(F.lit(OPEN))
        read = lambda x: let(F.instr(x, SEP), lambda c: let(F.substr(x, c + len(SEP)), lambda t: turn(x, c, t, F.startswith(s, head))))
        return let(F.substr(s, F.length(head) + 1), read)

    turns = lambda p: F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), one)
    return let(F.split(rendered, CLOSE), turns)


def parse(rendered: Column) -> Column:
    return F.transform(
        bodies(rendered), lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text"))
    )


def first_difference(source: Column, parsed: Column) -> Column:
    """Number of the first turn that was not recovered; the number of turns if all were."""

    def compare(p: Column) -> Column:
        bad = F.transform(source, lambda t, i: F.when(t.eqNullSafe(F.get(p, i)), F.lit(None)).otherwise(i))
        whole = F.when(F.size(source) == F.size(p), F.size(source)).otherwise(F.lit(0))
        return F.coalesce(F.array_min(bad), whole)

    return let(parsed, compare)


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and its ``turns`` (role, text) in order; null role or text is empty.

    Ties and repeated rows stay, ordered by role and text; a null turn number
    comes first.  Rows with a null id form one conversation of id null.  A
    conversation is one row here since its output is one string.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return (
        rows.groupBy(F.col(id_col).alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("t"))
        .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def format_chats(chats: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds ``formatted``, ``loss_spans`` (start, end in code points) and ``recovered`` turns.

    Round trip: everything is rendered plainly and parsed; from the first turn
    that does not come back on, texts are escaped, and the result is parsed
    again.  All turns before that one came back, and escaped texts hold no
    control string, so the second result is always the source; a difference
    raises an error rather than being passed on.  ``loss_spans`` cover the
    texts of ``loss_role`` as they stand in ``formatted``.
    """
    plain = chats.withColumn("_difference", let(render(F.col("turns"), F.size("turns")), lambda r: first_difference(F.col("turns"), parse(r))))
    done = plain.withColumn("formatted", render(F.col("turns"), F.col("_difference"))).withColumn("recovered", parse(F.col("formatted")))
    checked = F.when(F.col("recovered") == F.col("turns"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation did not survive its round trip"))
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + len(OPEN + SEP) + F.length(t["role"])
        end = start + F.length(t["text"])
        mine = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(unescape_role(t["role"]) == loss_role, F.concat(a["spans"], mine)).otherwise(a["spans"])
        return F.struct((end + len(CLOSE + END)).alias("at"), spans.alias("spans"))

    return done.withColumn("formatted", checked).withColumn(
        "loss_spans", F.aggregate(bodies(F.col("formatted")), zero, step, lambda a: a["spans"])
    ).drop("_difference")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    cut = lambda f: F.transform(spans, lambda s: unescape(F.substr(f, s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(let(formatted, cut), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say, read back from them."""
    said = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = formatted.withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return loss.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
