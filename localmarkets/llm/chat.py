"""Chat formatting with typed content parts (native DataFrame code).

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``&`` becomes ``&amp;`` and
``<|`` becomes ``&lt;|`` (line breaks in roles ``&#10;``), so no control string can be written by a
user and the escape can be undone. A visitor handles each part by its type: text stays, image, audio
and document parts become placeholders in their order, with the attachment's reference and the
number of tokens that it will expand to. Texts are escaped after the parts of a turn are joined, so
parts can't make up a control string between them. The loss mask covers the texts of assistant turns.

Defined results: null texts are empty, null roles are empty roles; rows of one turn number are
ordered by role and by the text before it is escaped; repeated rows are separate turns; parts of an unknown type are taken as
text; an empty table gives an empty result. Other columns may have any name, they aren't read.
A conversation is one output string, so its turns meet in one row however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PATCH = 14  # pixels of an image patch's side
AUDIO_RATE = 25  # tokens a second
PAGE_TOKENS = 576  # tokens a document page
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def _ampersands(text: Column) -> Column:
    return F.replace(text, F.lit("&"), F.lit("&amp;"))


def _openings(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("&lt;|"))


def escape(text: Column) -> Column:
    return _openings(_ampersands(text))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _patches(part: Column) -> Column:
    side = lambda c: F.ceil(F.coalesce(part[c], F.lit(PATCH)) / PATCH)
    return (side("width") * side("height")).cast("long")


#: What is written for a part of each type, and the tokens that it expands to.
VISITORS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "image": ("<|image|>", _patches),
    "audio": ("<|audio|>", lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE).cast("long")),
    "document": ("<|document|>", lambda p: (F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS).cast("long")),
}


def _mark(kind: str) -> Column:
    """Stands for a placeholder until the parts are joined; no text has it, as its ampersands are escaped."""
    return F.lit(f"&{kind};")


def visit(part: Column) -> Column:
    """struct(text, ref, tokens) of one part; the text still has to be joined with its neighbours."""
    text = F.coalesce(_ampersands(part["text"]), F.lit(""))
    ref, tokens = F.lit(None).cast("string"), F.lit(0).cast("long")
    for kind, (_, size) in VISITORS.items():
        mine = part["type"].eqNullSafe(F.lit(kind))
        text, ref, tokens = F.when(mine, _mark(kind)).otherwise(text), F.when(mine, part["ref"]).otherwise(ref), F.when(mine, size(part)).otherwise(tokens)
    return F.struct(text.alias("text"), ref.alias("ref"), tokens.alias("tokens"))


def flatten_parts(parts: Column) -> Column:
    """struct(text, attachments, tokens): the parts in order as one escaped text, their references, what they expand to."""
    seen = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit)
    text = _openings(F.array_join(F.transform(seen, lambda p: p["text"]), ""))
    for kind, (placeholder, _) in VISITORS.items():
        text = F.replace(text, _mark(kind), F.lit(placeholder))
    return F.struct(
        text.alias("text"),
        F.filter(F.transform(seen, lambda p: p["ref"]), lambda r: r.isNotNull()).alias("attachments"),
        F.aggregate(seen, F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"),
    )


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    none = F.lit(None)
    fields = {"type": F.lit("text"), "text": F.coalesce(text, F.lit("")), "ref": none, "width": none, "height": none, "seconds": none, "pages": none}
    return F.array(F.struct(*[c.alias(n) for n, c in fields.items()]).cast(PART))


def format_chat(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, parts) to one row per conversation: conv_id, formatted, loss_spans
    (code points, start and end), attachments, attachment_tokens."""
    flat = flatten_parts(F.col("parts"))
    role = F.coalesce(F.col("role"), F.lit(""))
    one = turns.select("conv_id", "turn", role.alias("role"), flat.alias("flat")).select("conv_id", "turn", "role", F.col("flat.text").alias("said"), F.col("flat.attachments").alias("refs"), F.col("flat.tokens").alias("tokens"))
    # Dealt once, by conversation; what can be told from the escaped text is made after that.
    one = one.repartition("conv_id")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    one = one.select(
        "conv_id", "turn", "role", F.concat(head, "said", F.lit(END)).alias("piece"), F.length(head).alias("skip"),
        F.length("said").alias("n"), unescape(F.col("said")).alias("raw"), "refs", "tokens",
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("piece").cast("long")).over(order) - F.length("piece") + F.col("skip")
    span = F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end")))
    rows = one.withColumn("at", start).select("conv_id", F.struct("at", "piece", span.alias("span"), "refs", "tokens").alias("t"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["refs"])).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("attachment_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """The turns of formatted texts: adds ``turns``, array of (role, text, on), where ``on`` is the loss mask."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    role = lambda p: unescape(F.substring_index(p, "\n", 1))
    text = lambda p: unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1))
    return chats.withColumn("turns", F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text"), (role(p) == "assistant").alias("on"))))
