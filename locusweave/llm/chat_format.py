"""Chat formatting from typed content parts (DataFrame only).

A turn holds parts of kind text, image, audio, document or other.  A visitor flattens them in order:
text is escaped, anything else becomes a placeholder `<kind>` while its reference, kind and
expanded token count go to the attachment list in the same order.  A kind that is no plain name (a-z, then a-z, 0-9, _),
or the name of the control string, is written `<other>`; the attachment list keeps it as it is.  A turn is written
`<turn>role\\n body</turn>\\n`.

Escaping: backslash to `\\b`, `<` to `\\l` (and in roles newline to `\\n`).  After it a text has no `<`, so no text
can forge a control string; every backslash starts one of the pairs, so undoing `\\l` and then
`\\b` restores the text exactly.

Defined cases: null text is empty, a null role is the empty role; turns with equal numbers
come in order of role and content as given, not as escaped; repeated rows are turns of their own; rows with a null
conv_id form one conversation; extra columns are ignored; an empty table gives no rows.  A conversation is one row of
the result, so one task writes all its turns, however long they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
PART = "array<struct<kind:string,text:string,ref:string,units:double>>"
# Tokens that one unit of an attachment expands to, beside one for the placeholder itself:
# image units are 28x28 patches, audio units seconds, document units pages.
EXPANSION = {"image": 1.0, "audio": 25.0, "document": 600.0}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _read_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _visit(part: Column) -> Column:
    """A part as it stands in the formatted text."""
    text = F.coalesce(part["text"], F.lit(""))
    kind = F.coalesce(part["kind"], F.lit("text"))
    plain = kind.rlike("^[a-z][a-z0-9_]*\\z") & (kind != "turn")
    return F.when(kind == "text", escape(text)).otherwise(F.concat(F.lit("<"), F.when(plain, kind).otherwise(F.lit("other")), F.lit(">")))


def _expanded(part: Column) -> Column:
    rate = F.lit(0.0)
    for kind, tokens in EXPANSION.items():
        rate = F.when(part["kind"] == kind, F.lit(tokens)).otherwise(rate)
    return (F.lit(1) + F.ceil(F.coalesce(part["units"], F.lit(0.0)) * rate)).cast("bigint")


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", parts: str | None = None, trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans (array of begin, end in code points, of the
    bodies of trained roles), attachments (array of ref, kind, tokens), n_turns, attachment_tokens."""
    one = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    content = F.col(parts).cast(PART) if parts else F.array(one).cast(PART)
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("_role"),
        F.coalesce(content, F.array().cast(PART)).alias("_parts"),
    )
    rows = rows.withColumn("_body", F.array_join(F.transform("_parts", _visit), ""))
    rows = rows.withColumn("_head", F.concat(F.lit(OPEN), _role(F.col("_role")), F.lit("\n")))
    refs = F.transform(
        F.filter("_parts", lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"),
        lambda p: F.struct(p["ref"].alias("ref"), p["kind"].alias("kind"), _expanded(p).alias("tokens")),
    )
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_parts")
    size = F.char_length("_head") + F.char_length("_body") + F.lit(len(CLOSE))
    rows = (
        rows.withColumn("_refs", refs)
        .withColumn("_seq", F.row_number().over(order))
        .withColumn("_end", F.sum(size.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE))
    )
    piece = F.struct(
        "_seq", F.concat("_head", "_body", F.lit(CLOSE)).alias("piece"), F.col("_role").isin(*trained).alias("loss"),
        (F.col("_end") - F.char_length("_body")).alias("begin"), F.col("_end").alias("end"), "_refs",
    )
    told = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count("*").alias("n_turns"))
    spans = F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
    return told.select(
        F.col("_conv").alias(conv), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"), F.flatten(F.transform("p", lambda x: x["_refs"])).alias("attachments"), "n_turns",
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array of (role, text) read back from a formatted conversation; a placeholder stays as it stands."""
    pieces = F.split(formatted, CLOSE)
    bodies = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(x: Column) -> Column:
        inner = F.substring(x, len(OPEN) + 1, 2147483647)
        at = F.instr(inner, "\n")
        return F.struct(
            _read_role(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substring(inner, at + 1, F.lit(2147483647))).alias("text")
        )

    return F.transform(bodies, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))
    return F.array_join(cut, "")


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests that are read back from the formatted text alone."""
    lines = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = formatted.select(
        conv, "formatted", lines.alias("lines"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    return read.select(
        conv, F.size("lines").cast("bigint").alias("n_turns"), F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
