"""Chat formatting with typed content parts (native).

A turn's content is a list of typed parts. The visitor flattens them in order:
text is escaped, an image, audio or document part becomes a placeholder, and its
reference, place and expanded token count are recorded. The template is

    <|turn|>ROLE<|text|>CONTENT<|end|>

Control strings inside texts are escaped with a backslash (and backslashes are
doubled), so the output can be split at the marks and unescaped to exactly what
went in. The loss mask is a list of (start, length) spans in code points of the
formatted text, one for each text part of an assistant turn.

Defined results: null text is empty; null roles are empty; turns stand by turn
number, null first, equal turns by role and text; a conversation without rows
doesn't appear; an empty table gives no rows; other columns are ignored. A
conversation is one value of the output, as large as its texts are together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that stand for an attachment: per image tile of 336 x 336, second of audio, page.
IMAGE_TILE, TILE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 336, 144, 25, 600
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Control strings of this and other common templates; each begins with one of < and [.
CONTROL = r"([<\[])(\|[a-z_]+\||/?s>|/?INST\]|</?SYS>>)"
PROBE_ID = -7
PROBE = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def part_tokens(part: Column) -> Column:
    tiles = F.ceil(F.coalesce(part["width"], F.lit(1)) / IMAGE_TILE) * F.ceil(F.coalesce(part["height"], F.lit(1)) / IMAGE_TILE)
    return (
        F.when(part["type"] == "image", tiles * TILE_TOKENS)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(0).cast("long"))


def flat_part(part: Column) -> Column:
    out = escaped(part["text"])
    for kind, mark in PLACEHOLDER.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def text_part(text: Column) -> Column:
    """The content of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def flattened(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to one row per turn with its formatted string, spans and attachments."""
    flat = F.transform("parts", lambda p: F.struct(
        F.when(p["type"].isin(*PLACEHOLDER), p["type"]).otherwise("text").alias("kind"), flat_part(p).alias("out"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(flat, F.array()).alias("flat")).withColumns({
        "head": head.cast("string"),
        "content": F.array_join(F.transform("flat", lambda p: p["out"]), ""),
    }).withColumn("formatted", F.concat("head", "content", F.lit(END)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to conv_id, formatted, loss_spans, turn_spans, attachments and expanded_tokens.

    turn_spans: the same loss mask turn by turn, spans counted from the turn's beginning."""
    flat = flattened(turns).withColumn("size", F.char_length("formatted"))
    order = ["turn", "role", "content"]
    # Places come from a running sum in the order of the turns, so that the
    # work stays linear in the length of a conversation.
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = flat.withColumns({"head_size": F.char_length("head"), "start": F.sum("size").over(before) - F.col("size") + F.char_length("head"), "place": F.row_number().over(before)})
    lengths = F.aggregate(
        "flat", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,ref:string,tokens:bigint,at:int,size:int>>").alias("seen")),
        lambda acc, p: F.struct((acc["at"] + F.char_length(p["out"])).alias("at"), F.concat(acc["seen"], F.array(F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), acc["at"].alias("at"), F.char_length(p["out"]).alias("size")))).alias("seen")),
        lambda acc: acc["seen"])
    placed = placed.withColumn("seen", lengths)
    masked = F.when(F.col("role") == "assistant", F.filter("seen", lambda p: p["kind"] == "text")).otherwise(F.filter("seen", lambda p: F.lit(False)))

    def spans(first: Column) -> Column:
        return F.transform(masked, lambda p: F.struct((first + p["at"]).cast("long").alias("start"), p["size"].cast("long").alias("length")))

    attached = F.transform(F.filter("seen", lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), (F.col("start") + p["at"]).cast("long").alias("start")))
    whole = placed.select("conv_id", F.struct("place", "formatted", spans(F.col("start")).alias("spans"), spans(F.col("head_size")).alias("own"), attached.alias("attached")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return whole.select(
        "conv_id", F.array_join("ts.formatted", "").alias("formatted"), F.flatten("ts.spans").alias("loss_spans"), F.col("ts.own").alias("turn_spans"), F.flatten("ts.attached").alias("attachments"),
        F.aggregate(F.flatten("ts.attached"), F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("expanded_tokens"))


def turns_of(formatted: Column) -> Column:
    """The formatted turns without their end marks; a text can't hold a mark, so each ends a turn."""
    pieces = F.split(formatted, r"<\|end\|>")
    return F.slice(pieces, 1, F.size(pieces) - 1)


def masked_text(formatted: Column, turn_spans: Column) -> Column:
    """What stands under the loss mask, as it was before it was formatted. Each span is cut out of its own turn."""
    cut = F.zip_with(turns_of(formatted), turn_spans, lambda turn, spans: F.transform(spans, lambda s: unescaped(F.substr(turn, (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return F.array_join(F.flatten(cut), "")


def parsed_turns(formatted: Column) -> Column:
    """The (role, text) structs that the formatted text was made of."""
    return F.transform(turns_of(formatted), lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"), unescaped(F.substr(p, F.locate(TEXT, p) + len(TEXT))).alias("text")))


def op6(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = format_conversations(turns.unionByName(probe).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    read = out.withColumns({
        "turns": parsed_turns(F.col("formatted")),
        "loss": masked_text(F.col("formatted"), F.col("turn_spans")),
    })
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (
  SELECT *, '<|turn|>' || role || '<|text|>'
    || regexp_replace(replace(text, '\', '\\'), '([<\[])(\|[a-z_]+\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g') || '<|end|>' AS formatted
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
