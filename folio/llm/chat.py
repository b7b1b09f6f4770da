"""Conversations as training text, by Spark expressions only.

The rows of a conversation are collected as structs and sorted; neighbouring rows of one role
share a block, with a mark between their texts; marks, texts and blocks are concatenated.  A
control string inside a text gets a backslash after its first character and a backslash is
doubled, so no text can open or close a block and reading back gives every row again.

Defined results: null text and null role count as empty; rows are ordered by turn (null first),
then role, then text; repeated rows stay; a role other than system, user and assistant has a
block that names it; an empty table gives an empty one; extra columns are ignored; a very long
text is escaped and kept whole.  One conversation is one row of output, so its size bounds what a
task gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_NAME, OTHER_CLOSE, AGAIN = "[TURN]", "[:]", "[/TURN]", "[+]"
_REST = r"/?(?:INST\]|SYS\]|TURN\]|s>)|\+\]|:\]"
_BLOCK = r"(?s)(\[SYS\]|\[INST\]|<s>|\[TURN\])(.*?)(?:\[/SYS\]|\[/INST\]|</s>|\[/TURN\])"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"([<\[])(?={_REST})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(?={_REST})|\\(\\)", "$1$2")


def _mark(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in marks.items():
        out = F.when(role == k, F.lit(v)).otherwise(out)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: spans (1-based start, length in code points) of the assistant texts in formatted."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    row = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    chats = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    t = F.col("t")

    def piece(x: Column, i: Column) -> Column:
        first = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
        last = (i == F.size(t) - 1) | (F.get(t, i + 1)["role"] != x["role"])
        before = F.when(first, _mark(x["role"], OPEN, F.concat(F.lit(OTHER_OPEN), escaped(x["role"]), F.lit(OTHER_NAME)))).otherwise(F.lit(AGAIN))
        after = F.when(last, _mark(x["role"], CLOSE, F.lit(OTHER_CLOSE))).otherwise(F.lit(""))
        return F.struct(before.alias("before"), x["text"].alias("text"), after.alias("after"), (x["role"] == "assistant").alias("learn"))

    pieces = chats.select("conv_id", F.transform(t, piece).alias("p"))
    sized = pieces.select("conv_id", "p", F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["text"], x["after"])), "").alias("formatted"))
    # Running length of what comes before each text; one number per piece.
    start = F.aggregate(
        "p",
        F.struct(F.lit(1).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["before"]) + F.length(x["text"]) + F.length(x["after"])).alias("at"),
            F.when(x["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["before"])).alias("start"), F.length(x["text"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return sized.select("conv_id", "formatted", start.alias("loss"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text), one per row that went into the text."""
    heads, bodies = F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(1)), F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(2))
    blocks = F.arrays_zip(heads.alias("head"), bodies.alias("body"))

    def rows(b: Column) -> Column:
        other = b["head"] == OTHER_OPEN
        named = F.split(b["body"], r"\[:\]", 2)
        role = unescaped(F.get(named, 0))
        for k, v in OPEN.items():
            role = F.when(b["head"] == v, F.lit(k)).otherwise(role)
        texts = F.split(F.when(other, F.get(named, 1)).otherwise(b["body"]), r"\[\+\]", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, rows))


def digests(chats: DataFrame) -> DataFrame:
    """What a reader gets back from formatted and its loss spans, as counts and SHA-256 digests."""
    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("rows"), learned.alias("learned"))
    said = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("rows").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
