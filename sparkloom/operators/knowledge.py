"""The write path, consolidation, goals, and the overviews built from records."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions._regex import ascii_bounds
from sparkloom.functions import extract as N
from sparkloom.functions import security as Z
from sparkloom.functions import text as X
from sparkloom.functions.extract import hall_of
from sparkloom.functions.scoring import cosine, js_round
from sparkloom.operators import graph as G
from sparkloom.operators import relational as R
from sparkloom.shipping import ship

# --- write path --------------------------------------------------------------------------------------------


def prepare(rows: DataFrame, as_of: Column) -> DataFrame:
    """Incoming rows (id, content, content_type, source, tags) as they are stored.

    Private parts go, injected instructions and credentials are blocked, tags
    are canonical, a time phrase sets the expiry. Rows that may not be stored
    carry their reasons.
    """
    clean = Z.redacted(Z.sanitized(X.strip_private(F.col("content"))))
    out = rows.withColumn("content", clean).withColumn("tags", X.canonical_tags(F.col("tags")))
    return (
        out.withColumn("rejected", R.storage_gate(F.col("content"), F.col("content_type")))
        .withColumn("content_hash", X.content_hash(F.col("content"))).withColumn("trust", Z.trust_level(F.col("source")))
        .withColumn("expires_at", X.expiry(F.col("content"), as_of)).withColumn("influence", Z.influence(F.col("content")))
        .withColumn("tags", F.when(F.size("tags") > 0, F.col("tags")).otherwise(X.auto_tags(F.col("content"))))
    )


def without_duplicates(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New rows whose hash is neither stored nor that of an earlier new row (by created_at, id)."""
    key = ["content_type", "content_hash"]
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("created_at", "id"))).where("_r = 1").drop("_r")
    return first.join(stored.select(*key), key, "left_anti")


def create(rows: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """The rows that a batch adds to the store, with their initial quality."""
    ready = prepare(rows, as_of).where(F.size("rejected") == 0).drop("rejected")
    fresh = without_duplicates(ready, stored)
    return fresh.withColumn("quality_score", js_round(0.30 * F.col("importance") + 0.15, 3))


def chunked(rows: DataFrame, most: int = 1500, target: int = 500, overlap: int = 0) -> DataFrame:
    """Rows with long contents become a parent and its chunks: (id, parent_id, chunk_index, content)."""
    long_ = rows.where(F.length("content") > most)
    pieces = long_.select("id", F.posexplode(X.chunks("content", target, overlap)).alias("chunk_index", "content"))
    chunks = pieces.select(F.concat_ws("/", "id", "chunk_index").alias("id"), F.col("id").cast("string").alias("parent_id"), "chunk_index", "content")
    roots = rows.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("chunk_index"), "content")
    return roots.unionByName(chunks)


def semantic_duplicates(new: DataFrame, stored: DataFrame, least: float = 0.85, recent: int = 200) -> DataFrame:
    """(id, duplicate_of, similarity): for each new record the newest like one of its type and namespace.

    Both have id, content, content_type, namespace, tags, embedding and
    created_at. Only the ``recent`` newest stored records of a type and
    namespace are candidates; short contents are never duplicates, and a new
    record with tags must share one.
    """
    own = ["content_type", "namespace"]
    b = G.newest(stored, recent, *own).select(*own, F.col("id").alias("other"), F.col("embedding").alias("vb"), F.col("tags").alias("tb"), F.col("created_at").alias("t"))
    a = new.where(F.length("content") >= 50).select(*own, "id", F.col("embedding").alias("va"), F.coalesce("tags", F.array().cast("array<string>")).alias("ta"))
    b = b.withColumnsRenamed({c: f"{c}_b" for c in own})
    same = F.col("content_type").eqNullSafe(F.col("content_type_b")) & F.col("namespace").eqNullSafe(F.col("namespace_b"))
    near = a.join(b, same).where("id <> other").withColumn("s", F.round(cosine(F.col("va"), F.col("vb")), 9)).where(F.col("s") >= least)
    near = near.where((F.size("ta") == 0) | F.coalesce(F.arrays_overlap("ta", "tb"), F.lit(False)))
    order = Window.partitionBy("id").orderBy(F.desc("t"), "other")
    return near.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", F.col("other").alias("duplicate_of"), F.round("s", 6).alias("similarity"))


def near_duplicates(new: DataFrame, stored: DataFrame, least: float = 0.85, shared: float = 0.6, recent: int = 200, top: int = 3) -> DataFrame:
    """(id, existing, similarity): of the few stored records most like a new one, the first that holds most of its words.

    Columns as in ``semantic_duplicates``; candidates are the newest records of the namespace.
    """
    b = G.newest(stored, recent, "namespace").select("namespace", F.col("id").alias("other"), F.col("embedding").alias("vb"), F.col("content").alias("tb"))
    a = new.where(F.length("content") >= 50).select("namespace", "id", F.col("embedding").alias("va"), F.col("content").alias("ta"))
    near = a.join(b, "namespace").where("id <> other").withColumn("s", F.round(cosine(F.col("va"), F.col("vb")), 9)).where(F.col("s") >= least)
    order = Window.partitionBy("id").orderBy(F.desc("s"), "other")
    best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) >= 3))
    share = F.size(F.array_intersect(words(F.col("ta")), words(F.col("tb")))) / F.greatest(F.lit(1), F.size(words(F.col("ta"))))
    kept = best.where(share > shared).groupBy("id").agg(F.min_by(F.struct("other", "s"), "r").alias("m"))
    return kept.select("id", F.col("m.other").alias("existing"), F.round("m.s", 6).alias("similarity"))


def merged_content(old: Column, new: Column) -> Column:
    return F.when(F.contains(old, new), old).otherwise(F.concat_ws("\n\n", old, new))


def hierarchy_links(records: DataFrame, days: int = 7, cap: int = 15) -> DataFrame:
    """(narrative, id): records of the days before each narrative, the newest ones."""
    found = R.preceding_week(records.where("content_type = 'summary'"), records.where("content_type <> 'summary'"), days, cap)
    return found.select(F.col("theme_id").alias("narrative"), "id")


# --- consolidation and contradictions ----------------------------------------------------------------------


def basic_summary(members: DataFrame, tags: DataFrame, budget: int = 500) -> DataFrame:
    """(cluster, summary, merged): a heading, the key facts and then the context of a cluster's records, within some words.

    ``members`` has cluster, id, content, created_at; ``tags`` memory_id, tag.
    Sentences come in order of their records' time and count once. The first
    three facts are a paragraph, if it fits; further facts and then the other
    sentences are listed until the first that would exceed the budget. A list
    is cut to ``budget`` sentences before it is gathered, since each has a word.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    size = lambda c: F.size(F.split(c, r"\s+"))
    parts = F.filter(F.transform(F.split("content", r"[.!?]\n|[.!?]\s"), strip), lambda s: F.length(s) > 10)
    each = members.select("cluster", "created_at", "id", F.posexplode(parts).alias("i", "s"))
    once = each.groupBy("cluster", "s").agg(F.min(F.struct("created_at", "id", "i")).alias("at")).withColumn("fact", N.states_fact(F.col("s")))
    place = F.row_number().over(Window.partitionBy("cluster", "fact").orderBy("at"))
    some = once.withColumn("p", place).where(F.col("p") <= budget)
    listed = lambda fact: F.sort_array(F.collect_list(F.when(F.col("fact") == F.lit(fact), F.struct("p", "s", size(F.col("s")).alias("n")))))
    lists = some.groupBy("cluster").agg(listed(True).alias("facts"), listed(False).alias("more"))
    head = members.groupBy("cluster").agg(F.count_distinct("id").alias("merged"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    known = members.select("cluster", F.col("id").alias("memory_id")).join(tags, "memory_id").groupBy("cluster").agg(F.array_join(F.slice(F.sort_array(F.collect_set("tag")), 1, 5), ", ").alias("topics"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    dates = F.when(F.col("first") == F.col("last"), day("first")).otherwise(F.concat(day("first"), F.lit(" to "), day("last")))
    rows = head.join(known, "cluster", "left").join(lists, "cluster", "left").withColumn("heading", F.concat(F.coalesce("topics", F.lit("various topics")), F.lit(" ("), F.col("merged"), F.lit(" sources, "), dates, F.lit(")")))
    none = F.filter(F.array(F.struct(F.lit(0).alias("p"), F.lit("").alias("s"), F.lit(0).alias("n"))), lambda x: F.lit(False))
    rows = rows.withColumn("facts", F.coalesce("facts", none)).withColumn("more", F.coalesce("more", none))
    prose = F.concat(F.array_join(F.transform(F.slice("facts", 1, 3), lambda x: x["s"]), ". "), F.lit("."))
    used = size(F.col("heading")) + size(prose)
    rows = rows.withColumn("told", (F.size("facts") > 0) & (used <= budget)).withColumn("spent", F.when(F.col("told"), used).otherwise(size(F.col("heading")))).withColumn("prose", prose)

    def filled(items, start):
        """The listed lines that fit, up to the first that doesn't, and the words then spent."""
        begin = F.struct(start.cast("int").alias("n"), F.lit("").alias("text"), F.lit(False).alias("full"))
        take = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.concat(a["text"], F.lit("- "), x["s"], F.lit("\n")).alias("text"), F.lit(False).alias("full"))
        stop = lambda a: F.struct(a["n"].alias("n"), a["text"].alias("text"), F.lit(True).alias("full"))
        return F.aggregate(items, begin, lambda a, x: F.when(~a["full"] & (a["n"] + x["n"] <= budget), take(a, x)).otherwise(stop(a)))

    rest = F.slice("facts", 4, budget)
    rows = rows.withColumn("bullets", filled(rest, F.col("spent")))
    rows = rows.withColumn("context", filled(F.when(F.col("bullets")["n"] < budget, F.col("more")).otherwise(none), F.col("bullets")["n"]))
    text = F.concat(
        F.col("heading"), F.when(F.col("told"), F.concat(F.lit("\n\n"), F.col("prose"))).otherwise(""), F.when(F.size("facts") > 3, F.concat(F.lit("\n\n"), F.col("bullets")["text"])).otherwise(""),
        F.when((F.size("facts") > 0) & (F.size("more") > 0) & (F.col("bullets")["n"] < budget), "\n").otherwise(""), F.col("context")["text"],
    )
    return rows.select("cluster", F.regexp_replace(text, r"\s+$", "").alias("summary"), "merged")


def proper_nouns(text: Column) -> Column:
    """Capitalised words of a text that don't begin a sentence, each once."""
    parts = F.transform(F.split(text, r"[.!?]\s+"), lambda s: F.slice(F.split(s, r"\s+"), 2, 1_000_000))
    return F.array_distinct(F.filter(F.flatten(parts), lambda w: w.rlike("^[A-Z][a-z]+") & (F.length(w) >= 3)))


def summary_problems(summary: Column, sources: Column) -> Column:
    """Reasons against a summary of some source texts (an array), as an array of names.

    Lengths are asked for less strictly of two sources than of more; the share
    of names that a summary keeps falls with their number.
    """
    n, length = F.size(sources), F.length(summary)
    small = n <= 2
    matches = lambda p: F.regexp_count(summary, F.lit(ascii_bounds(p)))
    lines = F.filter(F.split(summary, "\n"), lambda x: F.trim(x) != "")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]")))
    whole = F.aggregate(sources, F.lit(0), lambda a, s: a + F.length(s))
    nouns = F.array_distinct(F.flatten(F.transform(sources, proper_nouns)))
    low = F.lower(summary)
    kept = F.size(F.filter(nouns, lambda w: F.contains(low, F.lower(w))))
    need = F.when(F.size(nouns) > 60, 0.15).when(F.size(nouns) > 30, 0.25).otherwise(0.5)
    header = summary.rlike(r"(?i)^\[Consolidated summary of \d+ memories")
    checks = (
        ("too_short", length < F.when(small, 80).otherwise(100)), ("mechanical_header", header), ("nested_marker", ~header & (matches(r"(?i)\[Consolidated summary of") > 0)),
        ("raw_ids", matches(r"\b01[A-Z0-9]{24,}\b") > 2), ("only_metadata", summary.rlike(r"(?i)^\s*\d+ sources|^\s*\d+ memories") & (length < 200)),
        ("mostly_bullets", (F.size(lines) >= 5) & (bullets / F.size(lines) > F.when(small, 0.95).otherwise(0.85))),
        ("too_much_lost", (whole > 500) & (length < 0.1 * whole)), ("names_lost", (F.size(nouns) > 0) & (kept / F.greatest(F.lit(1), F.size(nouns)) < need)),
    )
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks]))


def split_by_community(members: DataFrame, communities: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, part, id): clusters cut by their members' communities; a member without one forms a part with others like it.

    A member of several communities counts to the least one.
    """
    own = communities.groupBy("id").agg(F.min("community").alias("community"))
    parts = members.join(own, "id", "left").withColumn("part", F.coalesce(F.col("community").cast("string"), F.lit("none")))
    sizes = parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(sizes, ["cluster", "part"]).where(F.col("n") >= least).select("cluster", "part", "id")


def dismissals(contradictions: DataFrame, memories: DataFrame, as_of: Column, stale_days: int = 30) -> DataFrame:
    """(id, reason) of open contradictions that settle themselves, by the first rule that holds."""
    m = lambda s: memories.select(F.col("id").alias(f"memory_{s}_id"), F.col("is_active").alias(f"active_{s}"), F.col("superseded_by").alias(f"next_{s}"))
    rows = contradictions.where("status = 'pending'").join(m("a"), "memory_a_id", "left").join(m("b"), "memory_b_id", "left")
    live = lambda s: F.coalesce(F.col(f"active_{s}"), F.lit(False))
    reason = (
        F.when(F.col("active_a").isNull() | F.col("active_b").isNull(), "missing").when(~live("a") | ~live("b"), "archived")
        .when(F.coalesce(F.col("next_a") == F.col("memory_b_id"), F.lit(False)) | F.coalesce(F.col("next_b") == F.col("memory_a_id"), F.lit(False)), "superseded")
        .when(F.col("created_at") < as_of - F.make_dt_interval(F.lit(stale_days)), "stale")
    )
    return rows.select("id", reason.alias("reason")).where("reason IS NOT NULL")


# --- goals -------------------------------------------------------------------------------------------------


def goal_keywords(goals: DataFrame) -> DataFrame:
    """(goal_id, keywords) of active goals, from their titles."""
    return goals.where("status = 'active'").select(F.col("id").alias("goal_id"), X.content_words(F.col("title")).alias("keywords"))


def relevant_goals(records: DataFrame, goals: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, goal_id, share): goals some of whose keywords a record names.

    Goals with the same keywords have the same share, so that records meet sets
    of keywords; their goals are put in at the end. Sets and goals are broadcast
    while they are few.
    """
    words = goal_keywords(goals).where(F.size("keywords") > 0).withColumn("keywords", F.sort_array("keywords"))
    kinds = G.checkpointed(words.groupBy("keywords").agg(F.min("goal_id").alias("kind")))
    near = lambda df, most: F.broadcast(df) if df.limit(most + 1).count() <= most else df
    flat = kinds.select("kind", F.size("keywords").alias("n"), F.explode("keywords").alias("w"))
    named = records.select("id", F.explode(X.content_words(F.col("content"))).alias("w"))
    hits = named.join(near(flat, 100_000), "w").groupBy("id", "kind", "n").agg(F.count(F.lit(1)).alias("c"))
    found = hits.where(F.col("c") / F.col("n") >= least).select("id", "kind", F.round(F.col("c") / F.col("n"), 6).alias("share"))
    of = words.join(kinds, "keywords").select("kind", "goal_id")
    return found.join(near(of, 1_000_000), "kind").select("id", "goal_id", "share")


def milestones_done(goals: DataFrame) -> DataFrame:
    """(id, completed, total) from an array of (title, status)."""
    done = F.size(F.filter("milestones", lambda m: m["status"] == "completed"))
    return goals.select("id", done.alias("completed"), F.size("milestones").alias("total"))


# --- overviews ---------------------------------------------------------------------------------------------


def palace(memories: DataFrame, tag_lists: DataFrame) -> DataFrame:
    """(wing, hall, records, first): records of each namespace by hall, with the most important one."""
    rows = memories.where("is_active").join(tag_lists, "id", "left")
    hall = hall_of(F.coalesce("tags", F.array().cast("array<string>")), F.col("content"))
    return rows.groupBy(F.col("namespace").alias("wing"), hall.alias("hall")).agg(
        F.count(F.lit(1)).alias("records"), F.expr("max_by(id, struct(importance, -id))").alias("first")
    )


def tunnels(tags: DataFrame, memories: DataFrame, least: int = 2) -> DataFrame:
    """(tag, wings): tags that join several namespaces."""
    joined = tags.join(memories.where("is_active").select(F.col("id").alias("memory_id"), "namespace"), "memory_id")
    wings = joined.groupBy("tag").agg(F.sort_array(F.collect_set("namespace")).alias("w"))
    return wings.where(F.size("w") >= least).select("tag", F.array_join("w", ",").alias("wings"))


def wake_up(memories: DataFrame, per: int = 5) -> DataFrame:
    """(section, rank, id): a few records for each section of a short context."""
    active = memories.where("is_active")
    first = lambda name, rows, *order: rows.orderBy(*order, "id").limit(per).select(F.lit(name).alias("section"), "id", F.row_number().over(Window.orderBy(*order, "id")).cast("int").alias("rank"))
    return (
        first("important", active, F.desc("importance")).unionByName(first("recent", active, F.desc("created_at")))
        .unionByName(first("procedures", active.where("tier = 'procedural'"), F.desc("importance"))).unionByName(first("useful", active.where("useful_count > 0"), F.desc("useful_count")))
    )


def orientation(sections: list[tuple[str, DataFrame]], budget: int = 2000) -> DataFrame:
    """Prioritised sections (of columns content) within a token budget; one that doesn't fit is skipped.

    Each section is a top-k report; only its cost reaches the driver.
    """
    cost = lambda df: df.agg(F.coalesce(F.sum(F.ceil(F.length("content") / 4)), F.lit(0)).alias("c")).first()["c"]
    kept = R.fill_budget([(name, cost(df)) for name, df in sections], budget)
    chosen = [df.select(F.lit(name).alias("section"), F.lit(i).alias("priority"), "content") for i, (name, df) in enumerate(sections) if name in kept]
    out = chosen[0]
    for df in chosen[1:]:
        out = out.unionByName(df)
    return out


def article(memories: DataFrame, per_part: int = 50) -> DataFrame:
    """(slug, title, body): one article for each namespace, its best records in three parts and a timeline by month."""
    rows = memories.where("is_active").select("namespace", "id", "importance", "created_at", F.get(X.sentences(F.col("content")), F.lit(0)).alias("point")).where("point IS NOT NULL")
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("importance"), "id"))).where(F.col("_r") <= per_part)
    parts = R.thirds(best, "namespace", [F.desc("importance"), F.asc("id")])
    line = F.struct(F.when(F.col("part") == "top", 0).when(F.col("part") == "middle", 1).otherwise(2).alias("p"), "_r", F.concat(F.lit("- "), F.substring("point", 1, 160)).alias("l"))
    text = lambda k: F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(line)), lambda x: x["p"] == k), lambda x: x["l"]), "\n")
    months = rows.groupBy("namespace", F.date_format("created_at", "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    times = months.groupBy("namespace").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("m", "n"))), lambda x: F.concat_ws(": ", x["m"], x["n"].cast("string"))), "\n").alias("times"))
    body = F.concat(F.lit("# "), F.col("namespace"), F.lit("\n\n## Overview\n"), F.col("a"), F.lit("\n\n## More\n"), F.col("b"), F.lit("\n\n## Other\n"), F.col("c"), F.lit("\n\n## Timeline\n"), F.col("times"))
    grouped = parts.groupBy("namespace").agg(text(0).alias("a"), text(1).alias("b"), text(2).alias("c")).join(times, "namespace")
    return grouped.select(X.slug(F.col("namespace")).alias("slug"), F.col("namespace").alias("title"), body.alias("body"))


#: Records of an entity from which on its words are counted one by one, and records whose words are counted by one task.
HOT, PART = 10_000, 5_000


def entity_profiles(entities: DataFrame, bridge: DataFrame, memories: DataFrame, words: int = 5) -> DataFrame:
    """(entity_id, records, words): how many active records name an entity and their most frequent content words.

    A record's words go to each of its entities as one value and are counted
    where they arrive; of entities with more than ``HOT`` records, word by word,
    so that no task has all of them.
    """
    active = memories.where("is_active")
    texts = active.select(F.col("id").alias("memory_id"), F.array_join(X.content_words(F.col("content")), " ").alias("text"))
    counts = bridge.join(active.select(F.col("id").alias("memory_id")), "memory_id").groupBy("entity_id").agg(F.count_distinct("memory_id").alias("records"))
    counts = G.stored(counts)
    # As many parts as hold their words in memory.
    parts = 1 + (counts.agg(F.sum("records")).first()[0] or 0) // PART
    hot = counts.where(F.col("records") > HOT).select("entity_id", F.lit(True).alias("hot"))
    live = bridge.select("memory_id", "entity_id").join(F.broadcast(hot), "entity_id", "left").join(texts, "memory_id")

    def best(rows: DataFrame) -> DataFrame:
        each = rows.select("entity_id", F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("entity_id", "w").agg(F.count(F.lit(1)).alias("n"))
        return each.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "w"))).where(F.col("r") <= words)

    # Dealt by entity, so that neither the count nor the order needs a further exchange.
    every = best(live.where("hot IS NULL").repartition(parts, "entity_id")).unionAll(best(live.where("hot")))
    lists = every.groupBy("entity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), ",").alias("words"))
    known = entities.select(F.col("id").alias("entity_id"))
    return known.join(counts, "entity_id").join(lists, "entity_id", "left")


def expand_queries(queries: DataFrame, names: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, term): query words, their aliases, and entity names that share a word with the query.

    Names are joined by word, not compared with every query.
    """
    pairs = [(a, b) for name, short in X.P.ALIASES.items() for a in (name, *short) for b in (name, *short) if a != b]
    table = F.explode(F.array(*[F.struct(F.lit(a).alias("word"), F.lit(b).alias("term")) for a, b in pairs]))
    alias = queries.sparkSession.range(1).select(table.alias("x")).select("x.word", "x.term")
    words = queries.select("query_id", F.posexplode(X.query_terms(F.lower("query"))).alias("i", "word"))
    aliased = words.join(F.broadcast(alias), "word").select("query_id", "i", "term")
    named = names.select(F.explode(F.split(F.lower("name"), r"\s+")).alias("word"), F.lower("name").alias("term"))
    linked = named.join(F.broadcast(words), "word").select("query_id", "i", "term")
    every = aliased.unionByName(linked).groupBy("query_id", "term").agg(F.min("i").alias("i"))
    best = every.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("i", "term"))).where(F.col("r") <= most)
    return words.select("query_id", F.col("word").alias("term")).unionByName(best.select("query_id", "term")).distinct()


# Words that stand for others in a query.
SYNONYMS = {
    "export": ("generate", "output", "vault", "pipeline"), "import": ("ingest", "load", "parse"), "obsidian": ("vault", "markdown", "wikilink"),
    "gardening": ("maintenance", "cleanup", "consolidation", "pruning"), "consolidation": ("merge", "gardening", "clustering"), "maintenance": ("gardening", "cleanup", "upkeep"),
    "audit": ("review", "check", "inspect", "verify"), "compile": ("build", "generate", "assemble"), "wiki": ("article", "documentation", "knowledge"), "optimize": ("tuning", "improve", "enhance"),
    "retrieval": ("search", "recall", "finding"), "search": ("retrieval", "query", "find"), "friction": ("miss", "gap", "failure"), "quality": ("score", "health", "metric"),
    "prediction": ("forecast", "estimate", "calibration"), "goal": ("objective", "milestone", "target"), "technique": ("learning", "pattern", "how-to"), "bug": ("fix", "error", "issue", "broken"),
    "decision": ("chose", "selected", "architecture"),
}


def auto_expansion(query: Column, most: int = 8) -> Column:
    """Synonyms of a query's words, then its neighbouring words with a hyphen, as one string; null if there are none."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 2)
    known = F.create_map(*[F.array(*map(F.lit, v)) if i else F.lit(k) for k, v in SYNONYMS.items() for i in (0, 1)])
    same = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), F.array().cast("array<string>"))))
    fresh = F.filter(same, lambda s: ~F.array_contains(words, s))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit("-"), F.get(words, i + 1)))
    terms = F.slice(F.array_distinct(F.concat(fresh, pairs)), 1, most)
    return F.when(F.size(terms) > 0, F.array_join(terms, " "))


def hypothetical(queries: DataFrame, generate: Callable[[str], str], cache: DataFrame | None = None, as_of: Column | None = None, hours: int = 1) -> tuple[DataFrame, DataFrame]:
    """(queries with a made answer appended, the answers as cache rows (key, answer, made_at)).

    The generator is given by the caller and runs on the workers, once for each
    text that no cache row of the last hours answers; write the second table and
    pass it the next time. Null queries stay null.
    """
    ship(queries.sparkSession)
    now = F.current_timestamp() if as_of is None else as_of
    keyed = queries.select("query_id", "query", F.lower(F.trim("query")).alias("key"))
    keys = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("query").alias("query"))
    held = keys.select("key", "query").withColumns({"answer": F.lit(None).cast("string"), "made_at": F.lit(None).cast("timestamp")})
    if cache is not None:
        live = cache.where((F.col("made_at") > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("made_at") <= now))
        live = live.groupBy("key").agg(F.max_by("answer", "made_at").alias("answer"), F.max("made_at").alias("made_at"))
        held = keys.join(live, "key", "left")

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(generate)

    made = held.where("made_at IS NULL").select("key", F.pandas_udf(run, "string")("query").alias("answer"), now.alias("made_at"))
    answers = held.where("made_at IS NOT NULL").select("key", "answer", "made_at").unionByName(made)
    return keyed.join(answers.select("key", "answer"), "key", "left").select("query_id", F.when(F.col("query").isNotNull(), F.concat_ws(" ", "query", "answer")).alias("query")), answers
