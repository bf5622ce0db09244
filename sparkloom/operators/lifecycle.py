"""Lifecycle jobs: each returns the changes it proposes; applying them is a separate step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scoring import js_round

# Tiers that time does not touch, and tags of procedures and of monitoring reports.
PERMANENT = ("semantic", "procedural", "reference")
PROCEDURE_TAGS = ("technique", "learning", "how-to", "procedure")


def _before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def archive_candidates(
    memories: DataFrame, as_of: Column, stale_days: int = 90, max_importance: float = 0.3, max_access: int = 2, abandoned_days: int = 365,
    neglected_days: int = 14, neglected_importance: float = 0.5, forgotten_days: int = 30, forgotten_importance: float = 0.6,
) -> DataFrame:
    """Active records of passing tiers that may be archived, with the first reason that holds."""
    rows = memories.where(F.col("is_active") & ~F.col("tier").isin(*PERMANENT))
    old = lambda days: F.col("created_at") < _before(as_of, days)
    unread = F.col("access_count") == 0
    reason = (
        F.when((F.col("importance") < max_importance) & old(stale_days) & (F.col("access_count") < max_access), "stale")
        .when(unread & old(abandoned_days), "abandoned")
        .when(unread & (F.col("importance") < neglected_importance) & old(neglected_days), "neglected")
        .when(unread & (F.col("importance") < forgotten_importance) & old(forgotten_days), "forgotten")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason", "importance", "access_count", "created_at")


def expire(memories: DataFrame, as_of: Column) -> DataFrame:
    """Active records with their expiry (a day after creation for working ones without any) and whether it has passed."""
    day = F.col("created_at") + F.expr("INTERVAL 1 DAY")
    expires = F.coalesce("expires_at", F.when(F.col("tier") == "working", day))
    rows = memories.where("is_active").select("id", expires.alias("expires_at"))
    return rows.where("expires_at IS NOT NULL").withColumn("archived", F.col("expires_at") <= as_of)


def expire_reports(memories: DataFrame, tags: DataFrame, as_of: Column, report_tags: tuple[str, ...], ttl_days: int = 14, grace_days: int = 7) -> DataFrame:
    """Old, not very important machine reports without an expiry get one."""
    tagged = tags.where(F.col("tag").isin(*report_tags)).select(F.col("memory_id").alias("id"))
    rows = memories.where(
        F.col("is_active") & (F.col("source") == "mcp") & (F.col("importance") <= 0.6) & (F.col("created_at") < _before(as_of, ttl_days)) & F.col("expires_at").isNull()
    )
    return rows.join(tagged, "id", "left_semi").select("id", (as_of + F.make_dt_interval(F.lit(grace_days))).alias("expires_at"))


def adjust_importance(scored: DataFrame, central: DataFrame | None, as_of: Column, threshold: int = 5, age_days: int = 30) -> DataFrame:
    """New importance of records that were read often, never, or belong to central entities.

    ``scored`` comes from ``analytics.with_quality``; ``central`` has the ids of
    records linked to the most central entities.
    """
    i, q = F.col("importance"), F.col("quality")
    free = F.col("is_active") & (F.round(i, 2) != 1.0)
    boost = free & (F.col("access_count") >= threshold) & (i < 0.8)
    decay = free & (F.col("access_count") == 0) & (F.col("created_at") < _before(as_of, age_days)) & (i > 0.3) & (q < 0.2)
    nudge = free & (F.col("access_count") >= 3) & (F.col("access_count") < threshold) & (i < 0.8)
    first = (
        F.when(boost, js_round(F.least(F.lit(0.9), i + F.when(q >= 0.7, 0.10).otherwise(0.05)), 2))
        .when(decay, js_round(F.greatest(F.lit(0.1), i - 0.05), 2))
        .when(nudge, F.least(F.lit(0.9), js_round(i + 0.02, 2)))
    )
    rows = scored.select("id", "importance", "is_active", first.alias("first"), F.when(decay, "decay").otherwise("boost").alias("action"))
    if central is None:
        rows = rows.withColumn("new_importance", F.col("first"))
    else:
        rows = rows.join(central.select("id").distinct().withColumn("hub", F.lit(True)), "id", "left")
        lifted = F.least(F.lit(0.9), js_round(F.coalesce("first", "importance") + 0.05, 2))
        wins = F.coalesce("hub", F.lit(False)) & F.col("is_active") & (F.round(i, 2) != 1.0) & (i < 0.9)
        rows = rows.withColumn("new_importance", F.when(wins, lifted).otherwise(F.col("first")))
    return rows.where("new_importance IS NOT NULL AND new_importance <> importance").select("id", "action", F.col("importance").alias("old_importance"), "new_importance")


def recalibrate(memories: DataFrame, protect_pinned: bool = True) -> DataFrame:
    """Importance by rank, spread evenly over 0.10 to 0.90; ties are ranked by id.

    Ranks are global: the rows are sorted by range, counted for each partition,
    and the counts of earlier partitions added, so that no task sees them all.
    """
    rows = memories.where("is_active").select("id", "importance")
    if protect_pinned:
        rows = rows.where("importance <> 1.0")
    ranked = global_rank(rows, ["importance", "id"])
    place = F.when(F.col("n") == 1, 0.5).otherwise((F.col("rank") - 1) / (F.col("n") - 1))
    return ranked.select("id", F.col("importance").alias("old_importance"), js_round(0.10 + place * 0.80, 2).alias("new_importance"))


def global_rank(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank`` (from 1, by the given columns) and the number of rows ``n``, without a single-partition window.

    Values are cut into bins by sampled quantiles of the first column; the bins'
    sizes give each one's offset, and windows run inside the bins.
    """
    cuts = rows.selectExpr(f"percentile_approx({by[0]}, array({', '.join(str(i / 64) for i in range(1, 64))}), 10000) AS q")
    first = F.col(by[0])
    binned = rows.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter(F.coalesce("q", F.array().cast("array<double>")), lambda c: c < first))).drop("q")
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    offsets = sizes.select(
        "bin", (F.sum("c").over(Window.orderBy("bin")) - F.col("c")).alias("off"), F.sum("c").over(Window.partitionBy()).alias("n")
    )
    inner = F.row_number().over(Window.partitionBy("bin").orderBy(*by))
    return binned.withColumn("r", inner).join(F.broadcast(offsets), "bin").withColumn("rank", F.col("r") + F.col("off")).drop("bin", "r", "off")


def promote_tiers(memories: DataFrame, tags: DataFrame, as_of: Column) -> DataFrame:
    """Records whose tier changes, by the first rule that holds."""
    procedure = tags.where(F.col("tag").isin(*PROCEDURE_TAGS)).select(F.col("memory_id").alias("id")).distinct().withColumn("proc", F.lit(True))
    rows = memories.where("is_active").join(procedure, "id", "left")
    week = F.col("created_at") <= _before(as_of, 7)
    lasting = (F.col("useful_count") >= 2) | ((F.col("access_count") >= 5) & week & ((F.col("importance") >= 0.3) | (F.col("useful_count") >= 1)))
    new = (
        F.when((F.col("tier") == "episodic") & lasting, "semantic")
        .when((F.col("tier") == "episodic") & (F.col("source") != "consolidation") & F.col("proc"), "procedural")
        .when((F.col("tier") == "working") & ((F.col("access_count") > 0) | (F.col("useful_count") > 0)), "episodic")
    )
    return rows.withColumn("new_tier", new).where("new_tier IS NOT NULL").select("id", "tier", "new_tier")


def prune(log: DataFrame, column: str, as_of: Column, days: int = 90) -> DataFrame:
    """The rows of a log that a retention period keeps."""
    return log.where(F.col(column) >= _before(as_of, days))


def purge_candidates(memories: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Inactive records, long unchanged, that no active record supersedes into, with how many children go with them."""
    old = memories.where(~F.col("is_active") & (F.col("updated_at") < _before(as_of, days)))
    needed = memories.where("is_active AND superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id"))
    children = memories.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return old.join(needed, "id", "left_anti").join(children, "id", "left").select("id", "updated_at", F.coalesce("children", F.lit(0)).alias("children"))


def orphan_entities(entities: DataFrame, bridge: DataFrame, memories: DataFrame, least: int = 2) -> DataFrame:
    """Entities with fewer links to active records than asked for."""
    live = bridge.join(memories.where("is_active").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    counts = live.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return entities.join(counts, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links")).where(F.col("links") < least)


def canonical_rows(memories: DataFrame, normalise: bool = True) -> DataFrame:
    """Content hash of each root record, and the newest record of its duplicates."""
    text = F.lower("content")
    text = F.trim(F.regexp_replace(text, r"\s+", " ")) if normalise else text
    rows = memories.where("is_active AND parent_id IS NULL").select("id", "namespace", "content_type", "created_at", F.sha2(text, 256).alias("content_hash"))
    key = Window.partitionBy(F.coalesce("namespace", F.lit("")), "content_type", "content_hash").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.select("id", "content_hash", F.first("id").over(key).alias("canonical_id"), F.row_number().over(key).alias("rn"))


def replay_access(memories: DataFrame, log: DataFrame, links: DataFrame, step: float = 0.01, cap: float = 0.95, linked_step: float = 0.005, linked_cap: float = 0.85) -> DataFrame:
    """Counts and importance after a log of accesses: each one lifts the record, and less so its linked ones.

    Lifts are added up before the caps, which gives the same as one by one,
    as every lift of a kind has the same size.
    """
    hits = log.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"), F.max("accessed_at").alias("last"))
    both = links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionAll(links.select("target_id", "source_id")).distinct()
    near = hits.join(both, hits.id == both.a).groupBy(F.col("b").alias("id")).agg(F.sum("hits").alias("near"))
    i = F.col("importance")
    own = F.when(i < cap, F.least(F.lit(cap), i + step * F.coalesce("hits", F.lit(0)))).otherwise(i)
    lifted = F.when(F.col("own") < linked_cap, F.least(F.lit(linked_cap), F.col("own") + linked_step * F.coalesce("near", F.lit(0)))).otherwise(F.col("own"))
    rows = memories.where("is_active").join(hits, "id", "left").join(near, "id", "left")
    return rows.withColumn("own", own).select("id", (F.coalesce("hits", F.lit(0))).alias("accesses"), F.round(lifted, 6).alias("importance"), F.col("last").alias("last_accessed_at"))


def apply_changes(table: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """The table with the patch's non-null values in place of its own."""
    columns = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete_cascade(table: DataFrame, gone: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The table without the ids, and each dependent table without the rows that point to them."""
    kept = {"table": table.join(gone.select("id"), "id", "left_anti")}
    return kept | {name: df.join(gone.select(F.col("id").alias(column)), column, "left_anti") for name, (df, column) in children.items()}


def merge_metadata(old: Column, new: Column) -> Column:
    """Entries of both maps, the new ones winning; an entry whose new value is null goes."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, F.map_filter(new, lambda k, v: v.isNotNull()))


def stalled_goals(goals: DataFrame, progress: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    recent = progress.where(F.col("created_at") >= _before(as_of, days)).select("goal_id")
    return goals.where("status = 'active'").join(recent, F.col("id") == F.col("goal_id"), "left_anti")
