"""Filters, joins, set operations, windows and top-k over the record model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def conditions(
    content_type: str | None = None, source: str | None = None, after: Column | None = None, before: Column | None = None,
    min_importance: float | None = None, namespace: str | None = None, tier: str | None = None,
) -> Column:
    """One conjunction of the filters that are given, so that it reaches the scan as a whole."""
    parts = [F.lit(True)]
    for column, value in (("content_type", content_type), ("source", source), ("namespace", namespace), ("tier", tier)):
        if value is not None:
            parts.append(F.col(column) == value)
    if after is not None:
        parts.append(F.col("created_at") >= after)
    if before is not None:
        parts.append(F.col("created_at") <= before)
    if min_importance is not None:
        parts.append(F.col("importance") >= min_importance)
    return reduce(lambda a, b: a & b, parts)


def with_any_tag(memories: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    return memories.join(tags.where(F.col("tag").isin(wanted)).select(F.col("memory_id").alias("id")), "id", "left_semi")


def with_all_tags(memories: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    every = tags.where(F.col("tag").isin(wanted)).groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct("tag").alias("n"))
    return memories.join(every.where(F.col("n") == len(set(wanted))).select("id"), "id", "left_semi")


def in_session(memories: DataFrame, session_id: str) -> DataFrame:
    """Working records only of the given session."""
    return memories.where((F.col("tier") != "working") | (F.col("session_id") == session_id))


def metadata_weight(is_metadata: Column, mode: str = "penalize", penalty: float = 0.35) -> Column:
    """Factor for metadata records: 0 if they are excluded, the penalty, or 1."""
    factor = {"exclude": 0.0, "penalize": penalty, "off": 1.0}[mode]
    return F.when(is_metadata, factor).otherwise(1.0)


# Tags and keys that mark a record as metadata, and phrases of failed summaries.
METADATA_TAGS = ("benchmark", "run-summary", "metrics", "health-check", "regression", "progress")
METADATA_KEYS = ("$.benchmark", "$.is_metadata", "$.progress")


def infer_metadata(tags: Column, metadata: Column) -> Column:
    marked = F.size(F.array_intersect(tags, F.array(*[F.lit(t) for t in METADATA_TAGS]))) > 0
    keys = [F.get_json_object(metadata, k).isNotNull() for k in METADATA_KEYS]
    return F.coalesce(reduce(lambda a, b: a | b, [marked, *keys]), F.lit(False))


def storage_gate(content: Column, content_type: Column, least: int = 120) -> Column:
    """Reasons why a text may not be stored, as an array."""
    short = (F.length(F.trim(content)) < least) & ~content_type.isin("summary", "conversation")
    empty = F.length(F.trim(content)) == 0
    junk = content.rlike(r"(?i)^\s*(no (new )?information|nothing to (report|summari[sz]e)|n/a)\s*\.?\s*$")
    reasons = [F.when(short, "too_short"), F.when(empty, "empty"), F.when(junk, "no_content")]
    return F.array_compact(F.array(*reasons))


def preview(content: Column, width: int = 200) -> Column:
    return F.when(F.length(content) > width, F.concat(F.substring(content, 1, width), F.lit("..."))).otherwise(content)


def browse(memories: DataFrame, tags: DataFrame, where: Column, wanted: list[str] | None, limit: int = 20) -> DataFrame:
    rows = memories.where(F.col("is_active") & where)
    rows = with_any_tag(rows, tags, wanted) if wanted else rows
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


# --- joins -------------------------------------------------------------------------------------------------


def entity_names(entities: DataFrame, bridge: DataFrame, memories: DataFrame) -> DataFrame:
    """Entities of active records, each once (three-way equi-join)."""
    live = bridge.join(memories.where("is_active").select(F.col("id").alias("memory_id"), "namespace"), "memory_id")
    return live.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("entity_id", "name", "namespace").distinct()


def entity_counts(entities: DataFrame, bridge: DataFrame, memories: DataFrame) -> DataFrame:
    """All entities with how many active records name them, zero included."""
    live = bridge.join(memories.where("is_active").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    counts = live.groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("memory_id").alias("n"))
    return entities.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("memory_count"))


def co_occurrence(bridge: DataFrame, least: int = 2) -> DataFrame:
    """Entity pairs that share records (self-join on the record, lesser entity first)."""
    a = bridge.select("memory_id", F.col("entity_id").alias("a"))
    b = bridge.select("memory_id", F.col("entity_id").alias("b"))
    pairs = a.join(b, "memory_id").where("a < b").groupBy("a", "b").agg(F.count_distinct("memory_id").alias("shared"), F.min("memory_id").alias("first_memory"))
    return pairs.where(F.col("shared") >= least)


def without_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a < b) that no edge of either direction joins."""
    known = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, relationship) of edges seen from both ends, each once."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "relationship")
    return out.unionAll(edges.select("target", "source", "relationship")).distinct()


def temporal_neighbours(targets: DataFrame, memories: DataFrame, hours: int = 1, k: int = 5) -> DataFrame:
    """The nearest records in time of each target, within some hours.

    By moments, since targets of the same moment have the same neighbours but
    for themselves: the moments of an hour and of its two neighbours are
    numbered, a target's moment meets those numbered next to it, and of a moment
    its first records are enough. One more than asked for is taken each time,
    since a target is not its own neighbour.
    """
    width, most = hours * 3600 * 1_000_000, k + 1
    at = F.unix_micros("created_at").alias("u")
    known = memories.where("is_active AND created_at IS NOT NULL").select("id", at)
    first = known.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("id"))).where(F.col("r") <= most)
    moments = first.groupBy("u").agg(F.collect_list("id").alias("ids"))
    t = targets.where("created_at IS NOT NULL").select(F.col("id").alias("target_id"), at)
    b = F.floor(F.col("u") / width)
    points = moments.select("u", F.explode(F.sequence(b - 1, b + 1)).alias("b"), F.lit(1).alias("one")).unionAll(t.select("u").distinct().select("u", b.alias("b"), F.lit(0).alias("one")))
    # Of equal moments the record's is counted first.
    count = F.sum("one").over(Window.partitionBy("b").orderBy("u", F.desc("one")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = points.withColumn("c", count)
    asked = placed.where("one = 0").select("b", F.col("u").alias("t"), F.explode(F.sequence(F.col("c") - k, F.col("c") + most)).alias("c"))
    near = asked.join(placed.where("one = 1").select("b", "c", "u"), ["b", "c"]).withColumn("gap", F.abs(F.col("u") - F.col("t"))).where(F.col("gap") <= width)
    order = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("gap", "id"))
    best = near.join(moments, "u").select("t", "gap", F.explode("ids").alias("id")).withColumn("r", order("t")).where(F.col("r") <= most)
    rows = t.withColumnRenamed("u", "t").join(best.select("t", "gap", "id"), "t").where(F.col("id") != F.col("target_id"))
    return rows.withColumn("rank", order("target_id")).where(F.col("rank") <= k).select("target_id", "id", "rank", (F.col("gap") / 1e6).alias("seconds"))


def preceding_week(themes: DataFrame, episodes: DataFrame, days: int = 7, k: int = 5) -> DataFrame:
    """Episodes of the days before each theme, the most important ones.

    Time is cut into blocks of 1, 4, 16 … microseconds. The best episodes of
    each block are worked out once; the days before a theme are put together of
    a few blocks of each size, and themes of the same moment share the result.
    """
    span = days * 86_400_000_000
    sizes = [4**j for j in range(64) if 4**j <= span]
    at = F.unix_micros("created_at")
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("importance"), "id"))).where(F.col("rank") <= k)
    e = best(episodes.where("created_at IS NOT NULL").select("id", "importance", at.alias("u")), "u")
    down = lambda x, size: F.expr(f"({x} - pmod({x}, {size}L)) div {size}L")
    up = lambda x, size: F.expr(f"({x} + pmod(-{x}, {size}L)) div {size}L")
    blocks = e.select("id", "importance", F.posexplode(F.array(*[down("u", size) for size in sizes])).alias("level", "block"))
    tops = best(blocks, "level", "block").select("level", "block", "id", "importance")
    upto = lambda low, high: F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    wanted = []
    for j, size in enumerate(sizes):
        low, high = up("lo", size), down("t", size)
        # What is left of the whole blocks of the next size, and right of them.
        inner, outer = up("lo", size * 4) * 4, down("t", size * 4) * 4
        own = F.when(inner <= outer, F.concat(upto(low, inner), upto(outer, high))).otherwise(upto(low, high)) if j + 1 < len(sizes) else upto(low, high)
        wanted.append(own)
    t = themes.where("created_at IS NOT NULL").select(F.col("id").alias("theme_id"), at.alias("t"))
    asked = t.select("t", (F.col("t") - span).alias("lo")).distinct().select("t", F.posexplode(F.array(*wanted)).alias("level", "block")).select("t", "level", F.explode("block").alias("block"))
    found = best(asked.join(tops, ["level", "block"]).select("t", "id", "importance"), "t").select("t", "id", "rank")
    return t.join(found, "t").select("theme_id", "id", "rank")


def array_pairs(lists: DataFrame, column: str) -> DataFrame:
    """(a, b, n): how often two values stand in one sorted array, a before b, by array functions within the row."""
    pairs = F.expr(f"flatten(transform({column}, (x, i) -> transform(slice({column}, i + 2, size({column})), y -> struct(x AS a, y AS b))))")
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def tag_pairs(tags: DataFrame, least: int = 2) -> DataFrame:
    lists = tags.groupBy("memory_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return array_pairs(lists, "tags").where(F.col("n") >= least)


def two_hops(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes within two steps of the start nodes and the fewest steps to each."""
    near = neighbours(edges).select("node", "other").distinct()
    one = start.join(near, "node").select(F.col("other").alias("node"), F.lit(1).alias("hop"))
    two = one.select("node").distinct().join(near, "node").select(F.col("other").alias("node"), F.lit(2).alias("hop"))
    return one.unionAll(two).join(start, "node", "left_anti").groupBy("node").agg(F.min("hop").alias("hop"))


def linked(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Records one link away from the seeds in either direction, with their strongest link."""
    out = links.join(seeds.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"), "strength", "link_type")
    back = links.join(seeds.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"), "strength", "link_type")
    best = out.unionAll(back).groupBy("id").agg(F.max(F.struct("strength", "link_type")).alias("m"))
    return best.join(seeds.select("id"), "id", "left_anti").select("id", "m.strength", "m.link_type")


def namespace_or_tag(memories: DataFrame, tags: DataFrame, value: str, limit: int = 200) -> DataFrame:
    """Records of a namespace or with a tag: the union of two equi-filters instead of a join with OR."""
    rows = memories.where("is_active")
    tagged = rows.join(tags.where(F.col("tag") == value).select(F.col("memory_id").alias("id")), "id", "left_semi")
    both = rows.where(F.col("namespace") == value).select("id", "importance").unionAll(tagged.select("id", "importance")).dropDuplicates(["id"])
    return both.orderBy(F.desc("importance"), "id").limit(limit)


def judgments(log: DataFrame, memories: DataFrame) -> DataFrame:
    """Graded relevance of accessed records for each query: 1, and 1 more if found useful."""
    grade = 1 + F.when(F.col("useful_count") > 0, 1).otherwise(0)
    joined = log.where("query IS NOT NULL").join(memories.where("is_active").select(F.col("id").alias("memory_id"), "useful_count"), "memory_id")
    return joined.groupBy("query", "memory_id").agg(F.max(grade).alias("grade"))


# --- set operations and windows ----------------------------------------------------------------------------


def diff(memories: DataFrame, since: Column) -> DataFrame:
    """Each changed record once: archived, created or updated since."""
    kind = (
        F.when(~F.col("is_active") & (F.col("updated_at") >= since), "archived")
        .when(F.col("is_active") & (F.col("created_at") >= since), "created")
        .when(F.col("is_active") & (F.col("updated_at") >= since), "updated")
    )
    return memories.select("id", kind.alias("change")).where("change IS NOT NULL")


def candidate_pool(hits: DataFrame, newest: DataFrame) -> DataFrame:
    return hits.select("id").unionByName(newest.select("id")).dropDuplicates(["id"])


def capped_per_group(rows: DataFrame, group: str, cap: int = 3) -> DataFrame:
    """At most ``cap`` newest rows of each group; rows without a group all stay."""
    order = Window.partitionBy(group).orderBy(F.desc("created_at"), "id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col(group).isNull() | (F.col("_r") <= cap)).drop("_r")


def without_repeats(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_b", before).where(~F.col(value).eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_b")


def with_context(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def median_of_last(runs: DataFrame, key: str, value: str, last: int = 7) -> DataFrame:
    """Upper median of the last runs of each key."""
    recent = runs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("_r") <= last)
    values = recent.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return values.select(key, F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("median"))


def latest_per(rows: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def within_budget(rows: DataFrame, group: str, order: list, cost: Column, budget: int) -> DataFrame:
    """The first rows of each group whose costs fit a budget; the first one always stays, and the first overflow ends the list."""
    w = Window.partitionBy(group).orderBy(*order)
    spent = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).withColumn("_r", F.row_number().over(w)).where((F.col("spent") <= budget) | (F.col("_r") == 1)).drop("_r")


def thirds(rows: DataFrame, group: str, order: list) -> DataFrame:
    """Three parts of each group by rank: the top 30 % (at least 3), the next 40 %, the rest."""
    w = Window.partitionBy(group)
    n, rank = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    top = F.greatest(F.lit(3), F.ceil(n * 0.3))
    part = F.when(rank <= top, "top").when(rank <= top + F.ceil(n * 0.4), "middle").otherwise("rest")
    return rows.withColumn("part", part)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A reproducible random sample: the rows with the least hashes."""
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def in_order_of(ids: DataFrame, memories: DataFrame) -> DataFrame:
    """Records of an id array, in the array's order."""
    at = ids.select(F.posexplode("ids").alias("place", "id"))
    return at.join(memories, "id").orderBy("place")


def fill_budget(sections: list[tuple[str, int]], budget: int) -> list[str]:
    """Names of the sections that fit, in order; one that doesn't is skipped."""
    kept, spent = [], 0
    for name, cost in sections:
        if spent + cost <= budget:
            kept.append(name)
            spent += cost
    return kept
