"""Notes written from records: what is left out, how records are grouped, pages joined from chunks, and links in their text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import _clean
from sparkloom.functions import security as Z
from sparkloom.shipping import ship

# --- what is left out --------------------------------------------------------------------------------------


def _lines(text: Column) -> Column:
    """The trimmed lines of a text that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _share(lines: Column, test) -> Column:
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, test)) / F.size(lines)).otherwise(0.0)


def low_quality(content: Column) -> Column:
    """Shorter than 30 characters, or only digits and their punctuation; null counts as empty."""
    t = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", "")
    return (F.length(t) < 30) | t.rlike(r"^[\d.,\s:/-]+$")


def spoiled_summary(content: Column) -> Column:
    """A consolidated summary most of whose lines are numbers or headings without content."""
    lines = _lines(content)
    tests = (
        lambda s: s.rlike(r"^[-\s]*[\d.,\s/]+$"), lambda s: s.isin("Key facts:", "Specifics:"),
        lambda s: F.regexp_replace(s, r",\s*", "").rlike(r"^[-\s]*[\d.,\sv]+[\w-]*$"),
    )
    # A line counts once for each test that it meets.
    votes = sum((F.size(F.filter(lines, test)) for test in tests), F.lit(0))
    return F.coalesce(F.contains(content, F.lit("Consolidated summary of")) & (votes / F.size(lines) > 0.4), F.lit(False))


def worth_a_note(content: Column) -> Column:
    return ~low_quality(content) & ~spoiled_summary(content)


def prose_ratio(text: Column) -> Column:
    """Share of the lines that are headings or sentences; 0 without lines."""
    definition = "|".join(f"(?:{p})" for p in _clean.DEFINITIONS)
    return _share(_lines(text), lambda s: s.startswith("#") | ((F.length(s) >= 40) & F.contains(s, F.lit(" ")) & ~s.rlike(f"(?i){definition}")))


def cleaned(text, aggressive: bool = False) -> Column:
    """A text without page furniture and repeated lines; ``aggressive`` also drops type definitions. Null stays null.

    What a line does depends on the lines kept before it, so one pass of Python reads each text.
    """
    ship(SparkSession.active())

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _clean.clean_lines(t, aggressive))

    return F.pandas_udf(run, "string")(text)


# Words that are not the subject of a fact.
FACT_STOPWORDS = (
    "now", "has", "is", "was", "are", "the", "its", "this", "that", "can", "will", "have", "had", "not", "but", "and", "for", "with", "from", "also", "been", "each", "both", "all", "any", "may", "use", "set",
    "get", "new", "old", "run", "add", "how", "why", "fully", "always", "then", "only", "just", "very", "when", "what", "which", "where", "pairs.", "claim", "editor", "session", "migration", "scheduling",
)


def notable_facts(facts: DataFrame, least: float = 0.7) -> DataFrame:
    """Facts (subject, predicate, object, confidence) of named subjects whose object is a short phrase."""
    named = F.col("subject").rlike("^[A-Z]") & (F.length("subject") >= 3) & ~F.lower("subject").isin(*FACT_STOPWORDS)
    phrase = F.length("object").between(3, 60) & ~F.col("object").rlike(r"^\d+(\.\d+)*$")
    return facts.where((F.col("confidence") >= least) & named & phrase & (F.col("predicate") != "version"))


# --- grouping ----------------------------------------------------------------------------------------------


def decisions_by_month(memories: DataFrame, tags: DataFrame, tag: str = "decision") -> DataFrame:
    """(month, id): active records with a tag that are worth a note."""
    rows = memories.where("is_active").join(tags.where(F.col("tag") == tag).select(F.col("memory_id").alias("id")), "id", "left_semi")
    return rows.where(worth_a_note(F.col("content"))).select(F.date_format("created_at", "yyyy-MM").alias("month"), "id")


def knowledge_topic(content: Column) -> Column:
    """The first topic that a text names in its head, else general."""
    found = F.regexp_extract(content, r"Topics:\s*([^\]]+)\]", 1)
    first = F.regexp_replace(F.substring_index(found, ",", 1), r"^\s+|\s+$", "")
    return F.when(F.coalesce(first, F.lit("")) == "", "general").otherwise(first)


def by_topic(memories: DataFrame) -> DataFrame:
    """(topic, id): active semantic records of their own that are worth a note."""
    rows = memories.where("is_active AND tier = 'semantic' AND parent_id IS NULL").where(worth_a_note(F.col("content")))
    return rows.select(knowledge_topic(F.col("content")).alias("topic"), "id")


# --- pages from chunks -------------------------------------------------------------------------------------


def without_overlap(chunks: DataFrame, key: str, order: list[str], least: int = 20, most: int = 500) -> DataFrame:
    """Chunks (key, order, content) without the text with which the chunk before ends.

    Each chunk meets only its predecessor, so that a long page is many rows, not one value.
    """
    rows = chunks.withColumns({"_head": F.left("content", F.lit(most)), "_tail": F.right("content", F.lit(most))})
    rows = rows.withColumn("_tail", F.coalesce(F.lag("_tail").over(Window.partitionBy(key).orderBy(*order)), F.lit("")))
    longest = F.least(F.length("_tail"), F.length("_head"))
    sizes = F.when(longest >= least, F.sequence(F.lit(least), longest)).otherwise(F.array().cast("array<int>"))
    shared = F.array_max(F.filter(sizes, lambda n: F.endswith(F.col("_tail"), F.left("_head", n))))
    return rows.withColumn("content", F.substr("content", F.coalesce(shared, F.lit(0)) + 1)).drop("_head", "_tail")


def reference_pages(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, chunks, body): pages joined from their chunks and cleaned; those that are short or hardly prose are left out."""
    parts = without_overlap(chunks.select(key, *order, "content"), key, order)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "content"))), lambda x: x["content"]), "\n\n")
    pages = parts.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), joined.alias("body")).withColumn("body", cleaned("body", True))
    noise = (prose_ratio(F.col("body")) < 0.2) & (F.length("body") > 500)
    return pages.where(~noise & (F.length("body") >= 100))


# --- links in the text -------------------------------------------------------------------------------------


def link_names(pages: DataFrame) -> DataFrame:
    """(name, link, slug) of pages (section, slug, title): titles, and slugs as words where they differ."""
    link = F.concat(F.lit("[["), "section", F.lit("/"), "slug", F.lit("|"), "title", F.lit("]]"))
    words = F.replace(F.col("slug"), F.lit("-"), F.lit(" "))
    names = F.when(words == F.lower("title"), F.array("title")).otherwise(F.array(F.col("title"), words))
    return pages.select(F.explode(names).alias("name"), link.alias("link"), "slug").where(F.length("name") > 3)


def linked(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Notes (slug, body) whose lines link to the pages that they name, each page name once in a line, longest first.

    Front matter, code, headings and lists of links stay. Lines meet names on
    the name's first word, so that no note is compared with every page.
    """
    ship(notes.sparkSession)
    flat = notes.select("slug", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    w = Window.partitionBy("slug").orderBy("n")
    trimmed = F.trim("line")
    rows = flat.withColumn("_fences", F.sum(trimmed.startswith("```").cast("int")).over(w)).withColumn("_rules", F.sum((trimmed == "---").cast("int")).over(w))
    front = (F.first("line").over(w) == "---") & ((F.col("_rules") == 1) | ((F.col("_rules") == 2) & (trimmed == "---")))
    plain = ~front & (F.col("_fences") % 2 == 0) & ~trimmed.startswith("```") & ~trimmed.startswith("#") & ~trimmed.startswith("- [[")
    rows = rows.withColumn("_plain", plain).drop("_fences", "_rules")

    names = link_names(pages).select("name", "link", F.col("slug").alias("page"), F.regexp_extract(F.lower("name"), r"\w+", 0).alias("word")).where("word <> ''")
    words = rows.where("_plain").select("slug", "n", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    named = words.join(names, "word").where("slug <> page")
    order = F.sort_array(F.collect_set(F.struct((-F.length("name")).alias("l"), "name", "link")))
    found = named.groupBy("slug", "n").agg(F.transform(order, lambda x: x["name"]).alias("names"), F.transform(order, lambda x: x["link"]).alias("links"))

    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for line, names, links in parts:
            yield pd.Series([_clean.link_line(t, a, b) for t, a, b in zip(line, names, links, strict=True)])

    done = rows.join(found, ["slug", "n"], "left")
    some = done.where("names IS NOT NULL").withColumn("line", F.pandas_udf(run, "string")("line", "names", "links"))
    every = some.unionByName(done.where("names IS NULL")).groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return every.select("slug", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"))


# --- context files -----------------------------------------------------------------------------------------

# The headings of each format, by part, and how many records each part shows (none: all).
CONTEXT_FORMATS = {
    "claude": ("{} — Context", ("Architecture & Decisions", "Conventions", "Techniques & Patterns", "Key Facts"), None),
    "cursorrules": ("{} Rules", ("Architecture", "Conventions", "Patterns"), 10),
    "agents": ("{} Agent Context", ("Key Architecture Decisions", "Coding Conventions", "Learned Techniques", "Project Facts"), None),
}


def context_part(tags: Column, tier: Column) -> Column:
    """0 architecture, 1 conventions, 2 techniques, 3 facts, null for the rest."""
    has = lambda *names: F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names])), F.lit(False))
    return (
        F.when(has("decision", "architecture"), 0).when(has("technique", "learning") | (tier == "procedural"), 2)
        .when(has("convention", "style", "pattern"), 1).when(tier == "semantic", 3)
    )


def context_files(rows: DataFrame, style: str = "claude") -> DataFrame:
    """(name, body): a context file for each name from ranked rows (name, rank, content, tags, tier), each record a line."""
    title, headings, most = CONTEXT_FORMATS[style]
    clean = Z.sanitized(F.trim("content"))
    short = F.when(F.length(clean) > 500, F.concat(F.substring(clean, 1, 500), F.lit("..."))).otherwise(clean)
    parts = rows.select("name", "rank", context_part(F.col("tags"), F.col("tier")).alias("part"), short.alias("line"))
    grouped = parts.groupBy("name").agg(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "rank", "line")))).alias("found"))

    def part(i: int, heading: str) -> Column:
        lines = F.transform(F.filter("found", lambda x: x["part"] == i), lambda x: F.concat(F.lit("- "), x["line"]))
        lines = F.slice(lines, 1, most) if most else lines
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {heading}\n"), F.array_join(lines, "\n")))

    head = F.concat(F.lit("# "), F.format_string(title.replace("{}", "%s"), "name"))
    return grouped.select("name", F.concat_ws("\n\n", head, *[part(i, h) for i, h in enumerate(headings)]).alias("body"))
