"""Chat formatting with typed content parts (DataFrame functions only).

A turn's content is a list of parts; a plain text is a list of one.  The visitor turns them, in order, into one
text: neighbouring text parts are joined and then escaped, so that a control string cannot hide
across two parts; image, audio and document parts become placeholders, and
each attachment is recorded with its place, reference and the tokens it expands to.

A turn is written as ``<|start|>role<|sep|>text<|end|>``.  Control strings inside
a text get one backslash more after their first sign, so a raw control string never
occurs in escaped text and the escape can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import running_sum, stored

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# First sign and rest of every control string, as patterns: fixed values.
CONTROL = (
    ("<", r"/?s>|\|(?:start|sep|end|image|audio|document|im_start|im_end|endoftext)\|>"),
    (r"\[", r"/?INST\]"),
)
# Tokens that attachments expand to: per image patch, second of audio, document page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    """Add one backslash inside every control string, escaped ones included."""
    for first, rest in CONTROL:
        text = F.regexp_replace(text, rf"({first})(\\*)({rest})", r"$1\\$2$3")
    return text


def unescape(text: Column) -> Column:
    """Take the backslash of ``escape`` away again."""
    for first, rest in CONTROL:
        text = F.regexp_replace(text, rf"({first})\\(\\*)({rest})", "$1$2$3")
    return text


def visit(part: Column) -> Column:
    """What one part contributes: its plain text or a placeholder, and for attachments the tokens they expand to.

    An unknown kind with a text is a text; a null part contributes nothing.  Missing sizes count as 0.
    """
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    whole = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    patches = F.ceil(whole(part["width"]) / IMAGE_PATCH) * F.ceil(whole(part["height"]) / IMAGE_PATCH)
    tokens = (
        F.when(kind == "image", patches)
        .when(kind == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(kind == "document", whole(part["pages"]).cast("long") * PAGE_TOKENS)
    )
    text = F.when(tokens.isNull(), F.coalesce(part["text"], F.lit("")))
    for name, mark in PLACEHOLDERS.items():
        text = F.when(kind == name, F.lit(mark)).otherwise(text)
    return F.struct(F.when(part.isNotNull(), text).otherwise("").alias("text"), F.when(tokens.isNotNull(), kind).alias("kind"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"))


def flattened(seen: Column) -> Column:
    """Text of a turn from its visited parts: runs of texts are escaped as one, placeholders stay as they are."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    step = lambda now, p: F.when(p["kind"].isNull(), F.struct(now["done"].alias("done"), F.concat(now["open"], p["text"]).alias("open"))).otherwise(
        F.struct(F.concat(now["done"], escape(now["open"]), p["text"]).alias("done"), F.lit("").alias("open"))
    )
    return F.aggregate(seen, start, step, lambda now: F.concat(now["done"], escape(now["open"])))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss`` and ``attachments``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and either ``parts`` (list of typed parts) or
    ``text``.  Turns are ordered by turn number, then role, then content; a null turn comes first,
    null role or content is empty, a null ``conv_id`` is a conversation of its own.  ``loss``
    lists start and length, in characters of ``formatted``, of each assistant text; ``attachments``
    lists turn position, kind, reference and expanded tokens in order of appearance.
    Other columns are ignored; an empty table gives an empty result.
    """
    if "parts" in turns.columns:
        parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    else:
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split(": ") for x in PART[7:-1].split(", ")) if name not in ("kind", "text")]
        parts = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), *nothing))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform(parts, visit).alias("seen"))
    rows = rows.withColumn("content", flattened(F.col("seen")))
    rows = rows.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "content",
            F.transform(F.filter("seen", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"], p["ref"], p["tokens"])).alias("attached"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    piece = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), t["content"], F.lit(END))
    chats = chats.select("conv_id", "t", F.transform("t", piece).alias("pieces"))
    # starts of all turns in one sweep
    sizes = F.transform("pieces", lambda p: F.length(p).cast("long"))
    chats = chats.withColumn("starts", running_sum(sizes))
    spans = F.zip_with(
        "t",
        "starts",
        lambda t, s: F.struct(
            (s + len(START) + F.length(escape(t["role"])) + len(SEP)).alias("start"), F.length(t["content"]).cast("long").alias("length"), (t["role"] == "assistant").alias("on")
        ),
    )
    loss = F.transform(F.filter(spans, lambda x: x["on"]), lambda x: F.struct(x["start"], x["length"]))
    attachments = F.flatten(
        F.transform("t", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("position"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    )
    return chats.select("conv_id", F.array_join("pieces", "").alias("formatted"), loss.alias("loss"), attachments.alias("attachments"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Turns and learned texts as they stand in the formatted rows, unescaped.

    Returns ``conv_id``, ``turns`` (role and text of each), ``learned`` (the texts under the loss mask) and ``formatted``.
    """
    pieces = F.split("formatted", F.lit(r"<\|start\|>"), -1)
    turns = F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(p, SEP, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", turns.alias("turns"), learned.alias("learned"), "formatted")


def read_parts(chats: DataFrame) -> DataFrame:
    """Typed parts of every turn as they stand in the formatted rows: ``conv_id`` and ``turns`` (role, and kind, text, ref and tokens of each part).

    Neighbouring texts come back as one part, empty texts not at all; attachments get their references by their order.
    """
    mark = r"<\|(image|audio|document)\|>"
    pieces = F.filter(F.split("formatted", F.lit(r"<\|start\|>"), -1), lambda p: p != "")

    def part(kind: Column, text: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), ref.alias("ref"), tokens.alias("tokens"))

    def parts(content: Column, turn: Column) -> Column:
        none = F.lit(None)
        own = F.filter("attachments", lambda a: a["position"] == turn)
        texts = F.transform(F.split(content, F.lit(mark), -1), lambda t: part(F.lit("text"), unescape(t), none.cast("string"), none.cast("long")))
        kinds = F.zip_with(F.regexp_extract_all(content, F.lit(mark), F.lit(1)), own, lambda k, a: part(k, none.cast("string"), a["ref"], a["tokens"]))
        return F.filter(F.flatten(F.zip_with(texts, kinds, lambda t, a: F.array(t, a))), lambda x: x.isNotNull() & (F.coalesce(x["text"], F.lit("-")) != ""))

    turn = lambda p, i: F.struct(
        unescape(F.substring_index(p, SEP, 1)).alias("role"), parts(F.substring_index(F.substring_index(p, SEP, -1), END, 1), i).alias("parts")
    )
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"))


def formatted_chats(turns: DataFrame) -> DataFrame:
    """Write the formatted conversations and read them back."""
    return read_chats(stored(format_chats(turns), "chats"))
