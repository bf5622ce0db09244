"""Reports over search results, sparse text vectors, and small jobs over records and transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.security import url_risk
from sparkloom.operators import graph as G

# --- reports over search results (query_id, id, rank, score) -----------------------------------------------


def reasoning_brief(results: DataFrame, records: DataFrame, tag_lists: DataFrame, most: int = 15, width: int = 800) -> DataFrame:
    """(query_id, rank, id, score, created_at, tier, importance, tags, content): ranked evidence, long contents cut."""
    cut = F.when(F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit("...[truncated]"))).otherwise(F.col("content"))
    rows = results.where(F.col("rank") <= most).join(records, "id").join(tag_lists, "id", "left")
    return rows.select("query_id", "rank", "id", "score", "created_at", "tier", "importance", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), cut.alias("content"))


def brief_text(brief: DataFrame) -> DataFrame:
    """(query_id, body): the evidence of each query as one text, by rank."""
    tags = F.when(F.size("tags") > 0, F.array_join(F.slice("tags", 1, 6), ", ")).otherwise(F.lit("(no tags)"))
    head = F.concat_ws(" | ", F.concat(F.lit("["), "rank", F.lit("] id="), "id"), F.concat(F.lit("created="), F.date_format("created_at", "yyyy-MM-dd")), F.concat(F.lit("tier="), "tier"))
    entry = F.concat(head, F.lit("\ntags: "), tags, F.lit("\n"), F.col("content"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "\n\n---\n\n")
    return brief.groupBy("query_id").agg(joined.alias("body"))


def project_snapshot(results: DataFrame, records: DataFrame, tags: DataFrame, sections: dict[str, tuple[tuple[str, ...], int, bool]], since: Column) -> DataFrame:
    """(query_id, section, rank, id): the best results of each section.

    A section has the tags that it asks for (none: any), how many rows it takes
    and whether it takes recent records only.
    """
    dated = results.join(records.select("id", "created_at"), "id")
    out = []
    for name, (wanted, most, recent) in sections.items():
        rows = dated.where(F.col("created_at") >= since) if recent else dated
        if wanted:
            rows = rows.join(tags.where(F.col("tag").isin(*wanted)).select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        out.append(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", F.lit(name).alias("section"), "rank", "id"))
    return reduce(DataFrame.unionByName, out)


def topic_evolution(results: DataFrame, records: DataFrame, links: DataFrame, most: int = 30, links_each: int = 3) -> DataFrame:
    """(query_id, step, id, supersedes, superseded_by, linked): results in order of time, with their lineage and links to each other."""
    kept = results.where(F.col("rank") <= most).select("query_id", "id")
    older = records.where("superseded_by IS NOT NULL").groupBy(F.col("superseded_by").alias("id")).agg(F.min("id").alias("supersedes"))
    both = links.select("source_id", "target_id").unionAll(links.select("target_id", "source_id")).toDF("id", "other").distinct()
    near = kept.join(both, "id").join(kept.select("query_id", F.col("id").alias("other")), ["query_id", "other"])
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("other"))).where(F.col("r") <= links_each)
    listed = near.groupBy("query_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("other")), lambda x: x.cast("string")), ",").alias("linked"))
    rows = kept.join(records.select("id", "created_at", "superseded_by"), "id").join(older, "id", "left").join(listed, ["query_id", "id"], "left")
    step = F.row_number().over(Window.partitionBy("query_id").orderBy("created_at", "id"))
    return rows.select("query_id", step.alias("step"), "id", "supersedes", "superseded_by", F.coalesce("linked", F.lit("")).alias("linked"))


# --- sparse text vectors -----------------------------------------------------------------------------------


def plain_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 2)


def _term_shares(rows: DataFrame, key: str, text: str) -> DataFrame:
    own = rows.select(key, plain_tokens(F.col(text)).alias("ws")).withColumn("len", F.size("ws"))
    return own.select(key, "len", F.explode("ws").alias("w")).groupBy(key, "w", "len").agg((F.count(F.lit(1)) / F.col("len")).alias("tf"))


def tfidf_similarity(queries: DataFrame, docs: DataFrame, most: int = 10, broadcast_rows: int = 100_000) -> DataFrame:
    """(query_id, id, rank, score): cosine of sparse vectors of term share times ln(documents / (1 + documents with the term)).

    ``queries`` has query_id and text, ``docs`` id and text. Only terms that a
    query has are joined; a document's length runs over all of its terms.
    """
    n = docs.count()
    terms = G.checkpointed(_term_shares(docs, "id", "text"))
    df = terms.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("tf") * F.log(F.lit(float(n)) / (1 + F.coalesce("df", F.lit(0))))
    own = _term_shares(queries, "query_id", "text").join(df, "w", "left").select("query_id", "w", weight.alias("qv"))
    own = G.checkpointed(own)
    near = F.broadcast if own.limit(broadcast_rows + 1).count() <= broadcast_rows else (lambda x: x)
    weighed = terms.join(df, "w").select("id", "w", weight.alias("dv"))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("dv") * F.col("dv"))).alias("dn"))
    q_norms = own.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qv") * F.col("qv"))).alias("qn"))
    dots = weighed.join(near(own), "w").groupBy("query_id", "id").agg(F.sum(F.col("qv") * F.col("dv")).alias("dot"))
    found = dots.join(norms, "id").join(near(q_norms), "query_id").where("dn > 0 AND qn > 0").select("query_id", "id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "id", "rank", "score")


# --- small jobs --------------------------------------------------------------------------------------------

# Tags of reports about the store's own operation.
OPERATION_TAGS = (
    "health-check", "gardening", "dependency-audit", "session-cleanup", "config-backup", "state-reconciliation", "retrieval-tuning", "friction-bridging", "reweave", "watchlist", "goal-worker",
    "goal-review", "frequency-review",
)


def prune_candidates(memories: DataFrame, tag_lists: DataFrame, as_of: Column, origin: str = "operations", days: int = 14) -> DataFrame:
    """(id, category): active records that a one-off prune would take, each in the first category that fits."""
    has = lambda *names: F.arrays_overlap("tags", F.array(*[F.lit(n) for n in names]))
    old = F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))
    category = (
        F.when(has("run-summary") & old, "run summary").when(has(origin) & has(*OPERATION_TAGS) & old, "operation report").when(has("auto-digested", "session-digest") & old, "digest")
        .when(has("technique") & (F.col("access_count") == 0) & (F.col("useful_count") == 0), "unused technique")
    )
    return memories.where("is_active").join(tag_lists, "id").select("id", category.alias("category")).where("category IS NOT NULL")


# Folders that name no project.
NO_PROJECT = ("src", "lib", "dist", "packages", "node_modules")


def common_prefix(paths: DataFrame) -> DataFrame:
    """(session_id, project): the last telling folder that all paths (session_id, file_path) of a session share; null without one.

    The least and the greatest path of a session share what all of them share,
    so that no list of paths is gathered.
    """
    flat = F.replace("file_path", F.lit("\\"), F.lit("/"))
    ends = paths.where("file_path <> ''").groupBy("session_id").agg(F.min(flat).alias("a"), F.max(flat).alias("b"))
    x, y = F.split("a", "/"), F.split("b", "/")
    same = F.filter(F.transform(x, lambda s, i: F.struct(s.alias("s"), (F.slice(x, F.lit(1), i + 1) == F.slice(y, F.lit(1), i + 1)).alias("ok"))), lambda e: e["ok"])
    parts = F.filter(F.transform(same, lambda e: e["s"]), lambda s: s != "")
    telling = F.filter(parts, lambda s: ~s.isin(*NO_PROJECT))
    return ends.select("session_id", F.coalesce(F.get(F.reverse(telling), F.lit(0)), F.get(F.reverse(parts), F.lit(0))).alias("project"))


def result_links(pages: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, rank, url, title) of the links of stored result pages, redirects resolved, blocked addresses left out."""
    link = r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(link), F.lit(0))).alias("at", "m"))
    href = F.regexp_extract("m", link, 1)
    wrapped = F.regexp_extract(href, "[?&]uddg=([^&]+)", 1)
    url = F.when(wrapped != "", F.try_url_decode(wrapped)).otherwise(href)
    title = F.trim(F.regexp_replace(F.regexp_extract("m", link, 2), r"<[^>]+>", ""))
    rows = each.select("page_id", "at", url.alias("url"), F.coalesce(F.nullif(title, F.lit("")), url).alias("title")).where(url_risk(F.col("url")) != "blocked")
    order = Window.partitionBy("page_id").orderBy("at")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("page_id", "rank", "url", "title")


def bulk_import(items: DataFrame, most: int = 500) -> DataFrame:
    """(content, content_type, source, source_uri, importance, tags) of a batch as it enters the write path.

    A batch of more than ``most`` rows is refused as a whole, as are unknown
    types and weights outside 0 to 1; missing values get their defaults.
    """
    if items.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} rows at once")
    bad = items.where("content IS NULL OR content = '' OR importance < 0 OR importance > 1 OR content_type NOT IN ('text', 'conversation', 'note', 'summary')")
    if bad.limit(1).count():
        raise ValueError("contents must not be empty, types must be known, weights lie between 0 and 1")
    return items.select(
        "content", F.coalesce("content_type", F.lit("text")).alias("content_type"), F.lit("import").alias("source"), "source_uri", F.coalesce("importance", F.lit(0.5)).alias("importance"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
