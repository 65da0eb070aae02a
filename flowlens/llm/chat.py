r"""Chat formatting with typed content parts, in DataFrame functions alone.

A message is a role and a list of parts: text, image, audio or document. A visitor (one expression per type of
part) flattens the parts in order: text is escaped, any other part becomes an ordered placeholder
``<|image:0|>``, with a record of what it refers to and how many tokens it will expand to. A turn is
``<|im_start|>role\ntext<|im_end|>\n``. Inside texts and roles a backslash is doubled and ``<|`` becomes
``<\|`` (and a line break in a role ``\n``), so no text can hold a control string, and reading back is exact.

Defined results: a null text or role counts as empty, a null list of parts as one without parts; an unknown type of part becomes a placeholder of that
type that expands to no token; turns are ordered by turn (null first), then role and text, so repeated rows stay, side by side;
a row without conversation id belongs to the conversation null; an empty table gives an empty result
(the query adds its own conversation -1); columns that are not named above are ignored.
The turns of one conversation meet in one row, because its digest runs over all of them in order: a conversation
must fit in a string (2 GB). All work on texts is done before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import prepare, table

# fixed values: the template, and the tokens that a part expands to for each unit of its size
START, END = "<|im_start|>", "<|im_end|>"
PATCH, AUDIO_PER_S, PAGE = 28, 25, 1024

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
                     T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
                     T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())])


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # between doubled backslashes, a backslash is always a mark
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(parts, "\\")


def visit(parts: Column) -> tuple[Column, Column]:
    """The flattened text of a list of parts, and its attachments in order."""
    other = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    kind = lambda p: F.regexp_replace(F.coalesce(p["type"], F.lit("text")), r"[^a-z_]", "_")
    tokens = lambda p: F.coalesce(
        F.when(p["type"] == "image", F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH))
        .when(p["type"] == "audio", F.ceil(p["seconds"] * AUDIO_PER_S))
        .when(p["type"] == "document", p["pages"].cast("long") * PAGE), F.lit(0)).cast("long")
    attachments = F.transform(other, lambda p, i: F.struct(
        i.alias("number"), kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    number = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda p: F.coalesce(p["type"], F.lit("text")) != "text"))
    flat = F.transform(parts, lambda p, i: F.when(F.coalesce(p["type"], F.lit("text")) == "text", escape(p["text"]))
                       .otherwise(F.concat(F.lit("<|"), kind(p), F.lit(":"), number(i).cast("string"), F.lit("|>"))))
    return F.array_join(flat, ""), attachments


def format_conversations(messages: DataFrame, train_on: str = "assistant") -> DataFrame:
    """conv_id, turn, role, parts -> one row per conversation: formatted text, loss mask (for each trained turn its
    number, start and length in the formatted text, in code points), attachments, expanded tokens.

    Numbers of placeholders start at 0 in each message."""
    text, attachments = visit(F.coalesce(F.col("parts"), F.array().cast(messages.schema["parts"].dataType)))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = messages.select(
        "conv_id", "turn", role.alias("role"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        text.alias("body"), attachments.alias("files"))
    turns = turns.select("*", F.concat("head", "body", F.lit(END + "\n")).alias("piece"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.char_length("piece").cast("long")
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    turns = turns.select("conv_id", F.row_number().over(w).alias("no"), "role", "piece", "files", before.alias("before"),
                         F.char_length("head").alias("head"), F.char_length("body").alias("body"))
    # the window has brought the turns of a conversation together; this groups them where they are
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "role", "piece", "before", "head", "body", "files"))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["role"] == train_on), lambda x: F.struct(
        x["no"].alias("turn"), (x["before"] + x["head"]).alias("start"), x["head"].alias("within"), x["body"].alias("length")))
    files = F.flatten(F.transform("t", lambda x: x["files"]))
    return one.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), mask.alias("mask"),
                      files.alias("attachments"),
                      F.aggregate(files, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, mask -> conv_id, turns (role and text, unescaped), loss (trained texts, unescaped), formatted.

    Escaping leaves no END inside a text, so the formatted text splits exactly into turns."""
    pieces = F.split("formatted", r"(?<=<\|im_end\|>\n)")
    # what stands behind the last turn is empty
    df = formatted.select("conv_id", "formatted", "mask", F.filter(pieces, lambda x: x != "").alias("pieces"))
    body = lambda x: F.substring(x, len(START) + 1, F.char_length(x) - len(START) - len(END) - 1)
    turns = F.transform("pieces", lambda x: F.struct(
        unescape_role(F.substring_index(body(x), "\n", 1)).alias("role"),
        unescape(F.substring(body(x), F.instr(body(x), "\n") + 1, F.char_length(x))).alias("text")))
    loss = F.transform("mask", lambda m: unescape(F.substring(F.element_at("pieces", m["turn"]), m["within"] + 1, m["length"])))
    return df.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_chat_formatting: digests of every conversation, read back from its formatted text."""
    prepare(spark)
    says = END + START + "assistant ok"
    own = spark.sql("SELECT -1L AS conv_id, explode(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role))) AS r").select(
        "conv_id", "r.turn", "r.role", F.lit(says).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(own)
    null = lambda t: F.lit(None).cast(t)
    part = F.struct(F.lit("text").alias("type"), F.col("text"), null("string").alias("ref"), null("int").alias("width"),
                    null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))
    back = read_back(format_conversations(rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
        replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(head) + 1 + length(body) + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
