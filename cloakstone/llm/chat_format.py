r"""Chat formatting by a grammar round trip, in Spark expressions only.

    conversation := turn*        turn := "### " role ":\n" text "</turn>\n"

A role is URL-encoded. The parser takes every "###" for the start of a turn and every "</turn>" for an end, and un-escapes a text: it
drops the backslash within "#\#" and "<\/", and halves doubled backslashes. A turn is first rendered as it is; when the reparsed
conversation isn't the source, the turns that alone don't come back are escaped, and at last all of them, until the recovered turns
are identical. Escaping doubles backslashes first, so the later single ones can't be taken for source text.

Defined results: turns follow (turn, role, text), nulls first; a null role or text is the empty string; a null conv_id is a
conversation of its own; repeated rows are repeated turns; an empty table gives no rows; other columns are ignored. A conversation is one
string, so its turns meet in one row; that is the unit of the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ":\n", "</turn>\n"
TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, "#(?=##)", r"#\\")
    return F.replace(out, F.lit("</turn>"), F.lit(r"<\/turn>"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(r"<\/turn>"), F.lit("</turn>"))
    out = F.regexp_replace(out, r"#\\(?=#)", "#")
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), F.url_encode(role), F.lit(COLON), text, F.lit(END))


def render(turns: Column, texts) -> Column:
    """turns: array of (role, text); texts: the turn's rendered text."""
    return F.array_join(F.transform(turns, lambda t: render_turn(t["role"], texts(t))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, or null if it isn't of the grammar."""
    parts = F.split(formatted, "###", -1)
    turns = F.transform(
        F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)),
        lambda p: F.struct(
            F.url_decode(F.substring_index(F.substr(p, F.lit(2)), COLON, 1)).alias("role"),
            unescape(F.substr(p, F.locate(COLON, p) + F.lit(len(COLON)), F.greatest(F.lit(0), F.length(p) - F.locate(COLON, p) - F.lit(len(COLON) - 1 + len(END))))).alias("text"),
        ),
    )
    # a "###" in front of each turn only, a "</turn>" at each end only
    one_end = lambda p: p.startswith(" ") & p.contains(COLON) & p.endswith(END) & (F.size(F.split(p, "</turn>", -1)) == 2)
    good = (F.element_at(parts, 1) == "") & F.forall(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), one_end)
    return F.when(good, turns)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), formatted, parsed (the turns read back)."""
    order = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("_all")).select("conv_id", F.transform("_all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = render(F.col("turns"), lambda t: t["text"])
    alone = lambda t: F.coalesce(parse(render_turn(t["role"], t["text"])) == F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))
    some = render(F.col("turns"), lambda t: F.when(alone(t), t["text"]).otherwise(escape(t["text"])))
    every = render(F.col("turns"), lambda t: escape(t["text"]))
    same = lambda formatted: F.coalesce(parse(F.col(formatted)) == F.col("turns"), F.lit(False))
    first = turns.withColumn("formatted", plain)
    # each try is a column of its own, made only where the one before isn't identical
    second = first.withColumn("formatted", F.when(same("formatted"), F.col("formatted")).otherwise(some))
    third = second.withColumn("formatted", F.when(same("formatted"), F.col("formatted")).otherwise(every))
    return third.withColumn("parsed", parse(F.col("formatted")))


def digests(formatted: DataFrame) -> DataFrame:
    """What the parsed turns say: their digest, and the text under the loss mask (assistant turns)."""
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
