"""Import of records from six kinds of files, one reader for each, with the same columns.

Every reader gives content, content_type, source, source_uri, tags, importance,
tier and original_date; records without content are left out. JSON files may
hold one document over many lines (an array, or one object) or, with ``lines``,
one object a line, which Spark can split over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.extract import topics
from sparkloom.sources.ingest import read_vault

COLUMNS = ("content", "content_type", "source", "source_uri", "tags", "importance", "tier", "original_date")
_RECORD = "content string, content_type string, source_uri string, importance double, tags array<string>, tier string"
_BACKUP = f"version int, memories array<struct<{_RECORD.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>, entities variant, memory_entities variant, settings variant"
_CHATGPT = "title string, create_time double, mapping map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<variant>>>>>"
_MESSAGES = "array<struct<sender:string,role:string,text:variant,content:variant>>"
_CLAUDE = f"name string, title string, created_at string, updated_at string, chat_messages {_MESSAGES}, messages {_MESSAGES}"
#: Messages above which a conversation counts for more.
LONG_CONVERSATION = 10


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _records(rows: DataFrame, **given: Column) -> DataFrame:
    """``COLUMNS``, with what a reader does not know as null; empty content goes."""
    kinds = {"tags": "array<string>", "importance": "double"}
    made = [given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]
    return rows.select(*made).where(F.length(stripped(F.col("content"))) > 0)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records as JSON, or a backup (told by its version and tables), whose records come instead."""
    rows = spark.read.schema(f"{_RECORD}, {_BACKUP}").json(path, multiLine=not lines).withColumn("file", F.input_file_name())
    backup = (F.col("version") == 1) & F.col("memories").isNotNull() & F.col("entities").isNotNull() & F.col("memory_entities").isNotNull() & F.col("settings").isNotNull()
    own = F.struct("content", "content_type", "source_uri", "importance", "tags", "tier")
    each = rows.select("file", F.explode(F.when(F.coalesce(backup, F.lit(False)), F.col("memories")).otherwise(F.array(own))).alias("r"))
    r = lambda c: F.col(f"r.{c}")
    return _records(
        each, content=r("content"), content_type=F.coalesce(r("content_type"), F.lit("text")), source=F.lit("import"), source_uri=F.coalesce(r("source_uri"), F.col("file")),
        tags=r("tags"), importance=r("importance"), tier=r("tier"),
    )


def read_markdown(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A record for each section between second-level headings or rules; a heading is a separator only."""
    parts = _whole(spark, path).select("file", F.explode(F.split("value", r"(?m)^(?:## .+|---)$")).alias("part"))
    return _records(parts, content=stripped(F.col("part")), content_type=F.lit("text"), source=F.lit("import"), source_uri=F.col("file"))


def read_chat_blocks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A record for each block between empty lines."""
    parts = _whole(spark, path).select("file", F.explode(F.split("value", r"\n\n+")).alias("part"))
    return _records(parts, content=stripped(F.col("part")), content_type=F.lit("conversation"), source=F.lit("import"), source_uri=F.col("file"))


def _conversation(rows: DataFrame, kind: str, messages: Column, date: Column) -> DataFrame:
    """One record of a conversation (title, and an array of role and text): the messages under a heading, with the topics found in it as tags."""
    said = F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (F.length(stripped(m["text"])) > 0))
    line = lambda m: F.concat(F.lit("**"), F.when(m["role"] == "user", "User").otherwise("Assistant"), F.lit("**: "), stripped(m["text"]))
    told = rows.withColumn("said", said).where(F.size("said") > 0)
    text = F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), F.array_join(F.transform("said", line), "\n\n"))
    told = told.withColumn("text", text)
    return _records(
        told, content=F.col("text"), content_type=F.lit("conversation"), source=F.lit(kind), source_uri=F.col("file"),
        tags=F.concat(F.array(F.lit("imported"), F.lit(kind)), topics(F.col("text"))), importance=F.when(F.size("said") > LONG_CONVERSATION, 0.7).otherwise(0.5), original_date=date,
    )


def _text(v: Column) -> Column:
    """A variant's value where it is a string."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def read_chatgpt(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Conversations as maps of nodes, in the order in which they stand; of a message's parts only texts count."""
    rows = spark.read.schema(_CHATGPT).json(path, multiLine=not lines).withColumn("file", F.input_file_name())
    parts = lambda n: F.array_join(F.filter(F.transform(n["message"]["content"]["parts"], _text), lambda p: p.isNotNull()), "\n")
    messages = F.transform(F.map_values("mapping"), lambda n: F.struct(n["message"]["author"]["role"].alias("role"), parts(n).alias("text")))
    date = F.date_format(F.timestamp_millis(F.round(F.col("create_time") * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _conversation(rows, "chatgpt", messages, date)


def read_claude(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Conversations as lists of messages, whose text stands as such, or as a list of typed parts."""
    rows = spark.read.schema(_CLAUDE).json(path, multiLine=not lines).withColumn("file", F.input_file_name()).withColumn("title", F.coalesce("name", "title"))
    typed = lambda v: F.array_join(F.transform(F.filter(F.try_variant_get(v, "$", "array<struct<type:string,text:string>>"), lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    role = lambda m: F.coalesce(m["sender"], m["role"])
    one = lambda m: F.struct(
        F.when(role(m) == "human", "user").when(role(m) == "assistant", "assistant").alias("role"), F.coalesce(_text(m["text"]), typed(m["content"]), _text(m["content"]), F.lit("")).alias("text")
    )
    return _conversation(rows, "claude", F.transform(F.coalesce("chat_messages", "messages"), one), F.coalesce("created_at", "updated_at"))


def read_notes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A vault of notes: front matter and folders give tags and tier, links keep their label."""
    rows = read_vault(spark, path)
    return _records(
        rows, content=F.col("body"), content_type=F.lit("text"), source=F.lit("import"), source_uri=F.col("path"),
        tags=F.array_distinct(F.concat(F.array(F.lit("imported"), F.lit("obsidian")), "tags")), tier=F.col("tier"),
    )


READERS: dict[str, Callable[..., DataFrame]] = {
    "json": read_json, "markdown": read_markdown, "chatexport": read_chat_blocks, "chatgpt": read_chatgpt, "claude": read_claude, "obsidian": read_notes,
}


def read_import(spark: SparkSession, path: str, kind: str = "json", lines: bool = False) -> DataFrame:
    """Records from files of one of the kinds of ``READERS``."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(READERS)}")
    return READERS[kind](spark, path, lines)
