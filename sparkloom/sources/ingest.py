"""Readers of files, pages, transcripts and exports, and the notes written from records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions._regex import ascii_bounds
from sparkloom.functions import text as X
from sparkloom.functions._plain import character_histogram
from sparkloom.shipping import ship

# Embedding models and their dimensions.
MODELS = (
    ("bge-small-en-v1.5", 384), ("all-MiniLM-L6-v2", 384), ("bge-base-en-v1.5", 768), ("all-MiniLM-L12-v2", 384), ("bge-large-en-v1.5", 1024), ("e5-small-v2", 384),
)


def embedding_models(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(d).alias("dimensions")) for n, d in MODELS])
    return spark.range(1).select(F.inline(rows))


def hashed_embedding(text) -> Column:
    """A deterministic stand-in for a model; batches come as an iterator, so that a real model would load once for each task."""
    ship(SparkSession.active())

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(character_histogram)

    return F.pandas_udf(run, "array<float>")(text)


def read_markdown(spark: SparkSession, path: str, names: str = r"\.(md|markdown)$") -> DataFrame:
    """(source_uri, section_index, section) of Markdown files under a path, by a pattern of their names."""
    ship(spark)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("source_uri"), "value")
    return files.where(F.col("source_uri").rlike(names)).select("source_uri", F.posexplode(X.sections("value")).alias("section_index", "section"))


def replace_source(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of sources that were read again give way to the new ones."""
    kept = existing.join(new.select("source_uri").distinct(), "source_uri", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def page_chunks(pages: DataFrame, target: int = 500, overlap: int = 50) -> DataFrame:
    """(page_id, title, chunk_index, chunk) of stored pages."""
    ship(pages.sparkSession)
    read = pages.select("page_id", X.page_title(F.col("html")).alias("title"), X.decode_entities(X.html_to_text(F.col("html"))).alias("text"))
    return read.select("page_id", "title", F.posexplode(X.chunks("text", target, overlap)).alias("chunk_index", "chunk"))


TRANSCRIPT = "struct<type:string,message:struct<content:array<struct<type:string,text:string,name:string>>>>"


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Conversations as the lines of session transcripts: (session_id, line, value)."""
    block = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(block).alias("content")).alias("message")))
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line"), line.alias("value"))


def session_actions(lines: DataFrame) -> DataFrame:
    """(session_id, line, kind, summary) of what an assistant said or called in transcript lines."""
    read = lines.select("session_id", "line", F.from_json("value", TRANSCRIPT).alias("r")).where("r.type = 'assistant'")
    return read.select("session_id", "line", F.inline("r.message.content")).select("session_id", "line", F.col("type").alias("kind"), F.coalesce("name", F.substring("text", 1, 120)).alias("summary"))


def session_digest(actions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One digest row for each session, which expires, without immediate repeats."""
    w = Window.partitionBy("session_id").orderBy("line")
    fresh = actions.withColumn("p", F.lag("summary").over(w)).where(~F.col("summary").eqNullSafe(F.col("p")) | F.col("p").isNull())
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", "summary"))), lambda x: x["summary"])
    return fresh.groupBy("session_id").agg(F.count(F.lit(1)).alias("actions"), F.array_join(parts, "\n").alias("digest")).withColumn("expires_at", as_of + F.make_dt_interval(F.lit(days)))


# First lines with which an assistant only announces or closes an action (compared without case).
NARRATION = (
    r"^(let me|i'll|i will|now i|going to)\b.{0,80}$", r"^(here (are|is)|the (result|output|file|content))\b", r"^(reading|searching|looking|checking|running|editing)\b", r"^(done|ok|sure|yes|alright)[.!]?\s*$",
)
# Phrases of a sentence worth keeping from a session, by kind, the first kind that fits.
SESSION_FACTS = (
    ("decision", r"\b(?:decided to|chose|going with|will use|switched to|opting for|went with)\b"), ("discovery", r"\b(?:found that|discovered|turns out|the issue was|root cause|the problem was|the fix was)\b"),
    ("architecture", r"\b(?:architecture:|design:|approach:|pattern:|the approach is|the design is)\b"), ("learning", r"\b(?:learned that|note to self|important:|remember that|key insight|takeaway)\b"),
)


def is_narration(text: Column) -> Column:
    """Texts of under 30 characters, or whose first line only tells of an action; null counts as empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    first = F.substring_index(t, "\n", 1)
    return (F.length(t) < 30) | first.rlike(ascii_bounds("(?i)" + "|".join(f"(?:{p})" for p in NARRATION)))


def session_facts(texts: DataFrame, alike: float = 0.7) -> DataFrame:
    """(session_id, place, kind, fact) of a session's texts (session_id, line, text): telling sentences with their neighbours.

    A fact most of whose words an earlier fact of the session has is left out,
    as is one of over 300 characters.
    """
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.length(s) > 15)
    cut = texts.where(~is_narration(F.col("text"))).select("session_id", "line", parts.alias("s"))
    at = cut.select("session_id", "line", "s", F.posexplode("s").alias("i", "sentence"))
    kind = F.coalesce(*[F.when(F.col("sentence").rlike(f"(?i){p}"), k) for k, p in SESSION_FACTS])
    fact = F.trim(F.concat_ws(" ", F.get("s", F.col("i") - 1), "sentence", F.get("s", F.col("i") + 1)))
    found = at.withColumn("kind", kind).where("kind IS NOT NULL").select("session_id", "line", "i", "kind", fact.alias("fact"))
    flat = F.regexp_replace(F.lower("fact"), r"\s+", " ")
    once = found.withColumn("key", flat).where(F.length("key") <= 300).groupBy("session_id", "key").agg(F.min(F.struct("line", "i", "kind", "fact")).alias("f"))
    words = F.array_distinct(F.split("key", " "))
    rows = once.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("f.line", "f.i", "f.kind", "f.fact", words.alias("w")))).alias("all"))
    near = lambda a, b: F.size(F.array_intersect(a["w"], b["w"])) / F.greatest(F.size(a["w"]), F.size(b["w"])) > alike
    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda y: near(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("session_id", F.posexplode(kept).alias("place", "x")).select("session_id", "place", "x.kind", "x.fact")


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """(title, role, text) of an export whose messages stand in a map of nodes."""
    schema = "title string, mapping map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("title", F.explode(F.map_values("mapping")).alias("n"))
    return rows.select("title", F.col("n.message.author.role").alias("role"), F.array_join("n.message.content.parts", "\n").alias("text")).where("text IS NOT NULL AND text <> ''")


def read_vault(spark: SparkSession, path: str, names: str = r"\.md$") -> DataFrame:
    """(path, tags, tier, body) of a folder of notes with front matter; links keep their label, folders become tags."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value").where(F.col("path").rlike(names))
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", ""), r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    listed = F.filter(F.split(F.regexp_extract(front, r"(?m)^tags:\s*\[(.*?)\]", 1), r"\s*,\s*"), lambda t: t != "")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    tier = F.when(folder.rlike("(?i)reference|docs"), "reference").when(folder.rlike("(?i)technique|how-?to"), "procedural").otherwise("episodic")
    return rows.select("path", X.canonical_tags(F.concat(listed, F.array(folder))).alias("tags"), tier.alias("tier"), F.trim(body).alias("body"))


# --- notes written from records ----------------------------------------------------------------------------


def note_groups(tags: DataFrame, least: int = 5) -> DataFrame:
    """(id, note_group): the longest tag of a record; groups that are too small are one."""
    longest = tags.groupBy(F.col("memory_id").alias("id")).agg(F.min(F.struct((-F.length("tag")).alias("l"), "tag")).alias("m")).select("id", "m.tag")
    sizes = longest.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return longest.join(sizes, "tag").select("id", F.when(F.col("n") < least, "misc").otherwise(F.col("tag")).alias("note_group"))


def cross_links(tags: DataFrame, of: DataFrame | None = None, least: int = 2, most: int = 15) -> DataFrame:
    """(a, b, rank): for each record, or for those whose tags are ``of``, the others with most shared tags.

    Records with the same tags share as many with any other record, so that
    sets of tags are compared instead of records. Of a set, its first records
    are enough: one more than asked for, since a record is not its own link.
    """
    sets = lambda rows, name: rows.toDF(name, "tag").groupBy(name).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    records, own = sets(tags, "b"), sets(tags if of is None else of, "a")
    first = records.withColumn("r", F.row_number().over(Window.partitionBy("tags").orderBy("b"))).where(F.col("r") <= most + 1)
    kinds = first.groupBy("tags").agg(F.collect_list("b").alias("ids")).select("tags", "ids", F.array_min("ids").alias("y"))
    asked = own.groupBy("tags").agg(F.min("a").alias("x"))
    x, y = asked.select("x", F.explode("tags").alias("tag")), kinds.select("y", F.explode("tags").alias("tag"))
    shared = x.join(y, "tag").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    order = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "b"))
    best = shared.join(kinds.select("y", "ids"), "y").select("x", "n", F.explode("ids").alias("b")).withColumn("r", order("x")).where(F.col("r") <= most + 1)
    rows = own.join(asked, "tags").select("a", "x").join(best.select("x", "n", "b"), "x").where("a <> b")
    return rows.withColumn("rank", order("a")).where(F.col("rank") <= most).select("a", "b", "rank")


# Tags that say nothing about a technique's subject.
GENERIC_TAGS = ("technique", "learning", "discovery", "decision")


def first_topic(tag_lists: DataFrame) -> DataFrame:
    """(id, tag): the first tag of each record that names a subject, else general."""
    kept = F.filter("tags", lambda x: ~x.isin(*GENERIC_TAGS))
    return tag_lists.select("id", F.coalesce(F.get(kept, F.lit(0)), F.lit("general")).alias("tag"))


def section_of(tags: Column, content: Column, tier: Column) -> Column:
    """The first section of a vault that claims a record."""
    has = lambda *names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(has("goal", "goal-progress"), "goals").when(has("decision") | content.rlike(ascii_bounds(r"(?i)\bdecided\b")), "decisions").when((tier == "procedural") | has("technique", "how-to"), "techniques")
        .when(tier == "reference", "reference").when(tier == "semantic", "knowledge").otherwise("notes")
    )


def render_notes(rows: DataFrame) -> DataFrame:
    """(path, body): one page for each group, its records in order; (note_group, id, title, content) in."""
    entry = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("content"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), "\n\n")
    return rows.groupBy("note_group").agg(body.alias("body")).select(F.concat(X.slug(F.col("note_group")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.col("note_group"), F.lit("\n\n"), F.col("body")).alias("body"))


def changed_since(rows: DataFrame, mark: Column) -> DataFrame:
    """Rows above the high-water mark of the last run."""
    return rows.where(F.col("updated_at") > mark)
