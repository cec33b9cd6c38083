"""Chat formatting: a visitor flattens typed content parts into text with ordered placeholders.

A message's content is an array of parts (kind, text, ref, width, height, millis, pages).  The visitor has one
method for each kind, each giving a Column for what stands in the text and, for attachments, how many tokens
the placeholder expands to; the n-th placeholder of a conversation belongs to its n-th attachment.  So that no other
text looks like one, every ``<|`` of a text or role becomes ``<\\|``, and a role called like a placeholder or like the
end of a message gets an underscore in front.  Everything is built of Spark's own functions, so it runs inside
generated code and SQL can check it.

Cost at scale: one shuffle, of the formatted messages by conversation.

Defined results.  Messages are ordered by turn (null first), then role, then text; messages that repeat stay.
A null content, or a part of unknown kind, is left out; a null text, ref or number counts as empty, "" or 0,
and an attachment expands to at least one token.  A null role is "unknown".  A message without conv_id is a
conversation of its own.  A conversation is one row, so its messages must fit one; very long texts are passed on whole.  Empty
table: empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,millis:long,pages:int>"
PATCH, FRAME_MS, PAGE_TOKENS = 28, 40, 512


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


class Visitor:
    """What each kind of part becomes: (text, tokens it expands to); tokens are null for plain text."""

    def text(self, part: Column) -> tuple[Column, Column]:
        return escaped(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("long")

    def image(self, part: Column) -> tuple[Column, Column]:
        side = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / PATCH)
        return F.lit("<|image|>"), F.greatest(side(part["width"]) * side(part["height"]), F.lit(1)).cast("long")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.greatest(F.ceil(F.coalesce(part["millis"], F.lit(0)) / FRAME_MS), F.lit(1)).cast("long")

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), F.greatest(F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS, F.lit(1)).cast("long")

    kinds = ("text", "image", "audio", "document")

    def visit(self, part: Column) -> Column:
        """struct(text, kind, ref, tokens); null for a null part or one of unknown kind."""
        out = None
        for kind in self.kinds:
            text, tokens = getattr(self, kind)(part)
            one = F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.coalesce(part["ref"], F.lit("")).alias("ref"), tokens.alias("tokens"))
            out = F.when(part["kind"] == kind, one) if out is None else out.when(part["kind"] == kind, one)
        return out


def format_messages(messages: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """(conv_id, turn, role, text, attachments) of each message; attachments: array of struct(kind, ref, tokens)."""
    visitor = visitor or Visitor()
    flat = F.filter(F.transform(F.coalesce(F.col("content"), F.array().cast(f"array<{PART}>")), visitor.visit), lambda x: x.isNotNull())
    text = F.array_join(F.transform(F.col("_flat"), lambda x: x["text"]), "\n")
    held = F.transform(F.filter("_flat", lambda x: x["tokens"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    role = escaped(F.coalesce("role", F.lit("unknown")))
    role = F.when(role.isin(*[k for k in visitor.kinds if k != "text"], "end"), F.concat(F.lit("_"), role)).otherwise(role)
    return messages.select("conv_id", "turn", role.alias("role"), flat.alias("_flat")).select("conv_id", "turn", "role", text.alias("text"), held.alias("attachments"))


def format_chats(messages: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """(conv_id, prompt, attachments): attachments are struct(ordinal, kind, ref, tokens), ordinals from 0."""
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_alone")
    one = format_messages(messages, visitor).groupBy("conv_id", alone).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "attachments"))).alias("m"))
    prompt = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("<|end|>\n"))), "")
    held = F.transform(F.flatten(F.transform("m", lambda x: x["attachments"])), lambda x, i: F.struct(i.alias("ordinal"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    return one.select("conv_id", prompt.alias("prompt"), held.alias("attachments"))


def with_parts(conversations: DataFrame) -> DataFrame:
    """conversations (plain text) with attachments added by a fixed rule, as no table holds typed parts."""
    n = F.col("conv_id") * 7 + F.col("turn") * 3
    fields = (("text", "string"), ("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "long"), ("pages", "int"))
    full = lambda kind, **x: F.struct(F.lit(kind).alias("kind"), *[(x[f] if f in x else F.lit(None)).cast(t).alias(f) for f, t in fields])
    ref = lambda folder, end: F.concat(F.lit(f"{folder}/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(end))
    text = full("text", text=F.col("text"))
    image = F.when(n % 5 == 0, full("image", ref=ref("img", ".png"), width=n % 900 + 100, height=n % 700 + 60))
    audio = F.when(n % 7 == 0, full("audio", ref=ref("snd", ".wav"), millis=n % 60000 + 1))
    paper = F.when(n % 11 == 0, full("document", ref=ref("doc", ".pdf"), pages=n % 30))
    return conversations.select("conv_id", "turn", "role", F.array(image, text, audio, paper).cast(f"array<{PART}>").alias("content"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(with_parts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    joined = lambda f: F.array_join(F.transform("attachments", f), ",")
    return chats.select("conv_id", "prompt", F.size("attachments").cast("long").alias("n_attachments"), joined(lambda x: x["ref"]).alias("refs"), joined(lambda x: x["tokens"].cast("string")).alias("tokens"), F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("total_tokens"))


SQL = r"""
WITH m AS (
  SELECT conv_id, turn, CASE WHEN role IN ('image', 'audio', 'document', 'end') THEN '_' || role ELSE replace(coalesce(role, 'unknown'), '<|', '<\|') END AS role, replace(coalesce(text, ''), '<|', '<\|') AS text, conv_id * 7 + turn * 3 AS n, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS name,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone
  FROM conversations
), p AS (
  SELECT *, 0 AS k, '<|image|>' AS body, 'img/' || name || '.png' AS ref, CAST(greatest(ceil((n % 900 + 100) / 28.0) * ceil((n % 700 + 60) / 28.0), 1) AS BIGINT) AS tokens FROM m WHERE n % 5 = 0
  UNION ALL SELECT *, 1, text, NULL, NULL FROM m
  UNION ALL SELECT *, 2, '<|audio|>', 'snd/' || name || '.wav', CAST(greatest(ceil((n % 60000 + 1) / 40.0), 1) AS BIGINT) FROM m WHERE n % 7 = 0
  UNION ALL SELECT *, 3, '<|document|>', 'doc/' || name || '.pdf', CAST(greatest((n % 30) * 512, 1) AS BIGINT) FROM m WHERE n % 11 = 0
), message AS (
  SELECT conv_id, alone, turn, role, '<|' || role || '|>' || chr(10) || string_agg(body, chr(10) ORDER BY k) || '<|end|>' || chr(10) AS body,
    string_agg(ref, ',' ORDER BY k) AS refs, string_agg(CAST(tokens AS VARCHAR), ',' ORDER BY k) AS tokens, count(tokens) AS n, coalesce(sum(tokens), 0) AS total
  FROM p GROUP BY conv_id, alone, turn, role, text
)
SELECT conv_id, string_agg(body, '' ORDER BY turn, role, body) AS prompt, CAST(sum(n) AS BIGINT) AS n_attachments, coalesce(string_agg(refs, ',' ORDER BY turn, role, body), '') AS refs,
  coalesce(string_agg(tokens, ',' ORDER BY turn, role, body), '') AS tokens, CAST(sum(total) AS BIGINT) AS total_tokens
FROM message GROUP BY conv_id, alone
"""
