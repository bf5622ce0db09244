"""Usage, quality and calibration rollups.

Each function takes tables as DataFrames and returns a DataFrame; one-row
results stay DataFrames too. Ties in ordered reports are broken by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scoring import days_between, js_round, quality

ONE = F.lit


def link_counts(links: DataFrame) -> DataFrame:
    """Links of each record at either end: (id, link_count)."""
    return (
        links.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(ONE(1)).alias("link_count"))
    )


def with_quality(memories: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """Adds link_count, age_days and quality."""
    joined = memories.join(link_counts(links), "id", "left")
    joined = joined.withColumn("link_count", F.coalesce("link_count", ONE(0))).withColumn("age_days", days_between(as_of, F.col("created_at")))
    return joined.withColumn(
        "quality", quality(F.col("importance"), F.col("useful_count"), F.col("access_count"), F.col("link_count"), F.col("age_days"))
    )


def _element(values: str, at: Column) -> Column:
    return F.get(F.col(values), at.cast("int"))


def summary(memories: DataFrame) -> DataFrame:
    """Totals of active records; the median is the element at half the count, from counts of each value."""
    active = memories.where("is_active")
    totals = active.agg(
        F.count(ONE(1)).alias("total"),
        F.count(F.when(F.col("access_count") == 0, 1)).alias("never"),
        F.count(F.when(F.col("useful_count") > 0, 1)).alias("useful"),
    )
    # One row for each distinct count, not each record, reaches the window.
    per = active.groupBy("access_count").agg(F.count(ONE(1)).alias("n"))
    upto = per.withColumn("upto", F.sum("n").over(Window.orderBy("access_count")))
    median = upto.crossJoin(F.broadcast(totals.select("total"))).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("access_count").alias("m"))
    pct = lambda c: F.when(F.col("total") > 0, js_round(F.col(c) / F.col("total") * 1000) / 10).otherwise(0.0)
    return totals.crossJoin(median).select(
        F.col("total").alias("total_active"), pct("never").alias("never_accessed_pct"), pct("useful").alias("useful_pct"),
        F.coalesce("m", ONE(0)).alias("median_access_count"),
    )


#: Label and least count of each bucket.
ACCESS_BUCKETS = (("0", 0), ("1-5", 1), ("6-20", 6), ("21-100", 21), ("100+", 101))


def access_distribution(memories: DataFrame) -> DataFrame:
    bucket = F.lit(ACCESS_BUCKETS[0][0])
    for label, least in ACCESS_BUCKETS[1:]:
        bucket = F.when(F.col("access_count") >= least, label).otherwise(bucket)
    counts = memories.where("is_active AND access_count >= 0").groupBy(bucket.alias("label")).agg(F.count(ONE(1)).alias("n"))
    labels = memories.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x, _ in ACCESS_BUCKETS])).alias("label"))
    return labels.join(counts, "label", "left").select("label", F.coalesce("n", ONE(0)).alias("count"))


def tag_effectiveness(memories: DataFrame, tags: DataFrame, limit: int = 20, least: int = 3) -> DataFrame:
    joined = tags.join(memories.where("is_active").select("id", "useful_count"), F.col("memory_id") == F.col("id"))
    return _effectiveness(joined.groupBy("tag"), "tag", limit, least)


def _effectiveness(grouped, key: str, limit: int, least: int) -> DataFrame:
    return (
        grouped.agg(F.count(ONE(1)).alias("memory_count"), F.round(F.avg("useful_count"), 2).alias("avg_useful"))
        .where(F.col("memory_count") >= least).orderBy(F.desc("avg_useful"), F.asc(key)).limit(limit)
    )


def producer_quality(memories: DataFrame, by: str = "model_id", limit: int = 15, least: int = 3) -> DataFrame:
    rows = memories.where(F.col("is_active") & F.col(by).isNotNull())
    return _effectiveness(rows.groupBy(F.col(by).alias("producer")), "producer", limit, least)


def period(ts: Column, granularity: str) -> Column:
    """Label of a day, month or week; weeks start on Monday and count from 0 before the year's first one."""
    if granularity == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if granularity == "month":
        return F.date_format(ts, "yyyy-MM")
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def quality_trend(memories: DataFrame, access_log: DataFrame, granularity: str = "month", limit: int = 12) -> DataFrame:
    """Created, cumulative totals and searches of the latest periods that have active records.

    The windows run over one row for each period.
    """
    name = period(F.col("created_at"), granularity).alias("period")
    rows = memories.groupBy(name).agg(
        F.count(ONE(1)).alias("created_all"),
        F.count(F.when(F.col("is_active"), 1)).alias("created"),
        F.sum(F.when(F.col("is_active"), F.col("useful_count"))).alias("useful"),
        F.count(F.when(F.col("is_active") & (F.col("access_count") == 0), 1)).alias("never"),
    ).where("created > 0")
    running = lambda c: F.sum(c).over(Window.orderBy("period"))
    cumulative = rows.select(
        "period", "created", running("created_all").alias("total_memories"), running("useful").alias("u"), running("created").alias("n"), running("never").alias("v")
    )
    minute = F.concat_ws(":", "query", F.date_format("accessed_at", "yyyy-MM-dd'T'HH:mm"))
    searches = access_log.where("query IS NOT NULL").groupBy(period(F.col("accessed_at"), granularity).alias("period")).agg(F.count_distinct(minute).alias("s"))
    return (
        cumulative.join(searches, "period", "left")
        .select(
            "period", "created", "total_memories", F.coalesce("s", ONE(0)).alias("searches"),
            F.round(F.col("u") / F.col("n"), 2).alias("avg_useful"), F.round(100.0 * F.col("v") / F.col("n"), 1).alias("never_accessed_pct"),
        )
        .orderBy(F.desc("period")).limit(limit)
    )


def quality_histogram(scored: DataFrame, column: str = "quality_score") -> DataFrame:
    """Ten bins of active records' quality, the last one closed; empty bins stay."""
    q = F.col(column)
    bins = scored.where(F.col("is_active") & q.between(0, 1)).groupBy(F.least(F.floor(q * 10), ONE(9)).cast("int").alias("b")).agg(F.count(ONE(1)).alias("n"))
    every = scored.sparkSession.range(10).select(F.col("id").cast("int").alias("b"))
    label = F.concat_ws("-", F.format_number(F.col("b") / 10, 1), F.format_number((F.col("b") + 1) / 10, 1))
    return every.join(bins, "b", "left").select(label.alias("bucket"), F.coalesce("n", ONE(0)).alias("count"))


def nearest_rank(scores: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each share p the value at place floor(p * (n - 1)), exactly, from counts of each value."""
    n = scores.agg(F.count(column).alias("n"))
    counted = scores.crossJoin(F.broadcast(n))
    ordered = counted.groupBy("n", column).agg(F.count(ONE(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy(column)))
    return ordered.agg(*[F.min(F.when(F.col("upto") > F.floor(ONE(p) * (F.col("n") - 1)), F.col(column))).alias(name) for name, p in shares.items()])


def quality_distribution(scored: DataFrame) -> DataFrame:
    """Mean, places of the ordered scores, and counts at both ends, of active records' quality."""
    rows = scored.where("is_active").select("quality")
    totals = rows.agg(
        js_round(F.avg("quality"), 3).alias("avg"), F.count(F.when(F.col("quality") >= 0.5, 1)).alias("high_quality"),
        F.count(F.when(F.col("quality") < 0.2, 1)).alias("low_quality"), F.count(ONE(1)).alias("total"),
    )
    # Scores are rounded as reported before they are ordered, so that at most a thousand values meet in the window.
    rounded = rows.select(js_round(F.col("quality"), 3).alias("q"))
    return totals.crossJoin(nearest_rank(rounded, "q", {"p10": 0.1, "median": 0.5, "p90": 0.9}))


def retrieval_stats(memories: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """One row: share of searches with results, records never accessed for two weeks, and feedback."""
    searches = outcomes.agg(F.sum("search_count").alias("s"), F.sum(F.when(F.col("result_count_avg") > 0, F.col("search_count"))).alias("w"))
    active = memories.where("is_active").agg(
        F.count(F.when((F.col("access_count") == 0) & (F.col("created_at") <= as_of - F.expr("INTERVAL 14 DAYS")), 1)).alias("least_accessed_count"),
        F.count(F.when(F.col("useful_count") > 0, 1)).alias("total_with_feedback"),
        js_round(F.coalesce(F.avg(F.when(F.col("useful_count") > 0, F.col("useful_count"))), ONE(0.0)), 2).alias("avg_useful_count"),
    )
    rate = F.when(F.col("s") > 0, js_round(F.coalesce("w", ONE(0)) / F.col("s") * 1000) / 10).otherwise(0.0)
    return searches.select(rate.alias("hit_rate")).crossJoin(active)


def most_accessed(memories: DataFrame, limit: int = 10, width: int = 80) -> DataFrame:
    title = F.when(F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit("..."))).otherwise(F.col("content"))
    return memories.where("is_active").orderBy(F.desc("access_count"), "id").limit(limit).select("id", title.alias("title"), "access_count")


def query_outcomes(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """State by query from the search log: searches, mean results, feedback and last time."""
    searches = log.groupBy("query").agg(
        F.count(ONE(1)).alias("search_count"), F.avg("result_count").alias("result_count_avg"), F.max("created_at").alias("last_queried_at")
    )
    useful = feedback.groupBy("query").agg(F.count(ONE(1)).alias("feedback_count"))
    return searches.join(useful, "query", "left").withColumn("feedback_count", F.coalesce("feedback_count", ONE(0)))


def outcome_report(outcomes: DataFrame, sort_by: str = "searches", least: int = 1, limit: int = 20) -> DataFrame:
    rows = outcomes.where(F.col("search_count") >= least)
    if sort_by == "zero_feedback":
        rows = rows.where("feedback_count = 0")
    order = F.desc(F.col("feedback_count") / F.col("search_count")) if sort_by == "feedback_ratio" else F.desc("search_count")
    return rows.orderBy(order, "query").limit(limit).select(
        "query", "search_count", js_round(F.col("result_count_avg"), 1).alias("result_count_avg"), "feedback_count",
        (js_round(F.col("feedback_count") / F.col("search_count") * 1000) / 10).alias("feedback_ratio"), "last_queried_at",
    )


def misses(search_misses: DataFrame, as_of: Column, days: int = 7, limit: int = 10) -> DataFrame:
    recent = search_misses.where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("created_at") <= as_of))
    return (
        recent.groupBy("query").agg(F.count(ONE(1)).alias("count"), F.avg("max_score").alias("avg_max_score"), F.max("created_at").alias("last_seen"))
        .orderBy(F.desc("count"), F.desc("last_seen"), "query").limit(limit)
    )


def knowledge_gaps(search_misses: DataFrame, as_of: Column, days: int = 30, least: int = 2) -> DataFrame:
    """Queries missed again and again, with how severe that is."""
    rows = misses(search_misses, as_of, days, 1000).where(F.col("count") >= least)
    severity = F.when(F.col("count") >= 10, "critical").when(F.col("count") >= 5, "warning").otherwise("info")
    return rows.select("query", "count", severity.alias("severity"))


def store_stats(memories: DataFrame, tags: DataFrame) -> DataFrame:
    """Long form (metric, key, value): counts by type, source and tier, tags, and totals, in one pass for each table."""
    by = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("key")) for k, c in (("type", "content_type"), ("source", "source"), ("tier", "tier"))]))
    counts = memories.where("is_active").select(by.alias("x")).groupBy("x.metric", "x.key").agg(F.count(ONE(1)).alias("value"))
    total = memories.agg(F.count(ONE(1)).alias("t"), F.count(F.when(F.col("is_active"), 1)).alias("a"))
    totals = total.select(F.expr("stack(2, 'total', 'all', t, 'total', 'active', a) AS (metric, key, value)"))
    distinct = tags.agg(F.count_distinct("tag").alias("value")).select(F.lit("tags").alias("metric"), F.lit("distinct").alias("key"), "value")
    return counts.unionByName(totals).unionByName(distinct)


def date_range(memories: DataFrame) -> DataFrame:
    return memories.where("is_active").agg(F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def embedding_health(memories: DataFrame, embeddings: DataFrame, dimensions: int) -> DataFrame:
    joined = memories.where("is_active").join(embeddings.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dims")), "id", "left")
    return joined.agg(
        F.count(ONE(1)).alias("total"), F.count("dims").alias("embedded"), F.count(F.when(F.col("dims").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("dims") != dimensions, 1)).alias("wrong_dimensions"),
    )


def tag_health(tags: DataFrame) -> DataFrame:
    per = tags.groupBy("tag").agg(F.count(ONE(1)).alias("n"))
    return per.agg(F.count(ONE(1)).alias("distinct_tags"), F.sum("n").alias("assignments"), F.count(F.when(F.col("n") == 1, 1)).alias("used_once"))


def job_health(outcomes: DataFrame, as_of: Column, days: int = 14, alert: float = 0.5) -> DataFrame:
    """Runs of each job in a period, with its last error; an alert where too few succeed."""
    recent = outcomes.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    failed = F.when(~F.col("success"), F.struct("created_at", "id"))
    rows = recent.groupBy("job_name").agg(
        F.count(ONE(1)).alias("runs"), F.count(F.when(F.col("success"), 1)).alias("successes"), F.max("created_at").alias("last_run"),
        F.expr("max_by(error, CASE WHEN NOT success THEN struct(created_at, id) END)").alias("last_error"), F.max(failed).alias("f"),
    )
    rate = F.col("successes") / F.col("runs")
    return rows.select(
        "job_name", "runs", "successes", F.round(rate, 6).alias("success_rate"), "last_run", F.when(F.col("f").isNotNull(), F.col("last_error")).alias("last_error"),
        (rate < alert).alias("alert"),
    )


def outcome_value(resolution: Column) -> Column:
    return F.when(resolution == "true", 1.0).when(resolution == "false", 0.0).otherwise(0.5)


def _scored(predictions: DataFrame) -> DataFrame:
    rows = predictions.where("status = 'resolved'").withColumn("outcome", outcome_value(F.col("resolution")))
    return rows.withColumn("sq", F.pow(F.col("confidence") - F.col("outcome"), 2))


def calibration(predictions: DataFrame) -> DataFrame:
    """One row: Brier score and bias of resolved predictions."""
    totals = predictions.agg(F.count(ONE(1)).alias("total_predictions"))
    rows = _scored(predictions).agg(
        F.count(ONE(1)).alias("resolved_count"), js_round(F.coalesce(F.avg("sq"), ONE(0.0)), 4).alias("brier_score"),
        js_round(F.coalesce(F.avg(F.col("confidence") - F.col("outcome")), ONE(0.0)), 4).alias("overconfidence_bias"),
    )
    return totals.crossJoin(rows)


def calibration_curve(predictions: DataFrame) -> DataFrame:
    rows = _scored(predictions).where(F.col("confidence").between(0, 1))
    # Bounds are multiples of 0.1 in floating point, so each value is compared with them as such.
    decile = F.lit(0)
    for i in range(1, 10):
        decile = F.when(F.col("confidence") >= i * 0.1, i).otherwise(decile)
    return rows.groupBy(decile.alias("decile")).agg(
        js_round(F.avg("confidence"), 3).alias("predicted_avg"), js_round(F.avg("outcome"), 3).alias("actual_freq"), F.count(ONE(1)).alias("count")
    )


def calibration_domains(predictions: DataFrame) -> DataFrame:
    return _scored(predictions).groupBy("domain").agg(
        js_round(F.avg("sq"), 4).alias("brier_score"), js_round(F.avg((F.col("resolution") == "true").cast("double")), 3).alias("accuracy"), F.count(ONE(1)).alias("count")
    )


def calibration_trend(predictions: DataFrame) -> DataFrame:
    month = F.date_format("resolved_at", "yyyy-MM").alias("month")
    return _scored(predictions).groupBy(month).agg(js_round(F.avg("sq"), 4).alias("brier_score"), F.count(ONE(1)).alias("count"))


def track_record(predictions: DataFrame) -> DataFrame:
    resolved = F.col("status") == "resolved"
    right = resolved & (F.col("resolution") == "true")
    counted = predictions.agg(F.count(ONE(1)).alias("total"), F.count(F.when(resolved, 1)).alias("resolved"), F.count(F.when(right, 1)).alias("correct"))
    return counted.withColumn("correct_share", F.round(F.when(F.col("resolved") > 0, F.col("correct") / F.col("resolved")).otherwise(0.0), 6))


def task_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status", "assignee").agg(F.count(ONE(1)).alias("count"))


def next_tasks(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """Pending tasks by priority, then age."""
    order = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    return tasks.where("status = 'pending'").orderBy(order, "created_at", "id").limit(limit).select("id", "priority", "created_at")


def diary_agents(entries: DataFrame) -> DataFrame:
    return entries.groupBy("agent").agg(F.count(ONE(1)).alias("entries"), F.max("created_at").alias("last_entry"))


def timeline(memories: DataFrame, limit: int = 30) -> DataFrame:
    return (
        memories.where("is_active").groupBy(F.to_date("created_at").alias("date")).agg(F.count(ONE(1)).alias("count"))
        .orderBy(F.desc("date")).limit(limit)
    )


def timeline_records(memories: DataFrame, per_day: int = 20) -> DataFrame:
    """The most important records of each day."""
    order = Window.partitionBy("date").orderBy(F.desc("importance"), "id")
    rows = memories.where("is_active").select(F.to_date("created_at").alias("date"), "id", "importance")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_day)


def temporal_stats(memories: DataFrame, today: Column) -> DataFrame:
    """Days with records, mean per day, the busiest day and day streaks; windows run over one row for each day."""
    days = memories.where("is_active").groupBy(F.to_date("created_at").alias("d")).agg(F.count(ONE(1)).alias("n"))
    islands = days.withColumn("g", F.date_sub("d", F.row_number().over(Window.orderBy("d"))))
    streaks = islands.groupBy("g").agg(F.count(ONE(1)).alias("len"), F.max("d").alias("end"))
    streak = streaks.agg(F.max("len").alias("longest_streak"), F.max(F.when(F.datediff(today, F.col("end")) <= 1, F.col("len"))).alias("c"))
    base = days.agg(
        F.count(ONE(1)).alias("total_days"), js_round(F.sum("n") / F.count(ONE(1)), 1).alias("avg_per_day"),
        F.expr("max_by(d, struct(n, -datediff(d, date'1970-01-01')))").alias("busiest_day"), F.max("n").alias("busiest_count"),
    )
    return base.crossJoin(streak).select(
        "total_days", "avg_per_day", "busiest_day", "busiest_count", "longest_streak", F.coalesce("c", ONE(0)).alias("current_streak")
    )


def namespaces(memories: DataFrame, least: int = 1) -> DataFrame:
    rows = memories.where(F.col("is_active") & F.col("namespace").isNotNull()).groupBy("namespace").agg(F.count(ONE(1)).alias("count"))
    return rows.where(F.col("count") >= least)


def importance_stats(memories: DataFrame) -> DataFrame:
    x = F.col("importance")
    return memories.where("is_active").agg(
        js_round(F.avg(x), 3).alias("mean"), js_round(F.stddev_pop(x), 3).alias("std_dev"), F.min(x).alias("min"),
        *[F.round(F.percentile(x, p), 6).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))], F.max(x).alias("max"),
    )


def usefulness_groups(scored: DataFrame) -> DataFrame:
    """Means of accessed records' properties, useful or not, from which weights are tuned."""
    rows = scored.where("is_active AND access_count > 0").groupBy((F.col("useful_count") > 0).alias("useful"))
    return rows.agg(F.count(ONE(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("age_days", "access_count", "importance", "link_count")])


def tuned_weights(groups: DataFrame, weights: dict[str, float], nudge: float = 0.02, least: int = 5) -> DataFrame:
    """(weight, old, new) of the weights that change, from ``usefulness_groups``: each moves by at most one nudge towards what tells useful records from the others.

    No row while a group has fewer than ``least`` records.
    """
    one = lambda name, c: F.max(F.when(F.col("useful") == (name == "u"), F.col(c)))
    row = groups.agg(*[F.coalesce(one(g, c), F.lit(0)).alias(f"{g}_{c}") for g in ("u", "o") for c in ("n", "avg_age_days", "avg_access_count", "avg_importance", "avg_link_count")])
    move = lambda x, high, low: F.when(x > high, nudge).when(x < low, -nudge).otherwise(0.0)
    gap = lambda c: F.col(f"u_{c}") - F.col(f"o_{c}")
    by = {
        "recency": move(-gap("avg_age_days"), 5, -5), "frequency": move(F.col("u_avg_access_count") / F.greatest(F.lit(1.0), "o_avg_access_count"), 1.5, 0.67),
        "graph": move(gap("avg_link_count"), 0.5, -0.5), "usefulness": F.when(F.col("u_n") > 20, nudge).otherwise(0.0), "importance": move(gap("avg_importance"), 0.1, -0.1),
    }
    new = lambda name: js_round(F.greatest(F.lit(0.02), F.least(F.lit(0.5), F.lit(weights[name]) + by[name])), 2)
    rows = F.array(*[F.struct(F.lit(name).alias("weight"), F.lit(weights[name]).alias("old"), new(name).alias("new")) for name in by])
    return row.where((F.col("u_n") >= least) & (F.col("o_n") >= least)).select(F.inline(rows)).where("old <> new")


def health_checks(memories: DataFrame, embeddings: DataFrame, tags: DataFrame, entities: DataFrame, bridge: DataFrame) -> DataFrame:
    """Rows (check, value, status) of independent one-row aggregates."""
    active = memories.where("is_active")
    missing = active.join(embeddings.select(F.col("vec_id").alias("id")), "id", "left_anti").agg(F.count(ONE(1)).alias("m")).crossJoin(active.agg(F.count(ONE(1)).alias("t")))
    ladder = lambda v, warn, bad: F.when(v >= bad, "critical").when(v >= warn, "warning").otherwise("ok")
    share = lambda df, name, warn, bad: df.select(F.lit(name).alias("check"), F.round(F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(0.0), 6).alias("value")).withColumn("status", ladder(F.col("value"), warn, bad))
    untagged = active.join(tags.select(F.col("memory_id").alias("id")), "id", "left_anti").agg(F.count(ONE(1)).alias("m")).crossJoin(active.agg(F.count(ONE(1)).alias("t")))
    orphans = entities.join(bridge.select(F.col("entity_id").alias("id")), "id", "left_anti").agg(F.count(ONE(1)).alias("m")).crossJoin(entities.agg(F.count(ONE(1)).alias("t")))
    unused = active.agg(F.count(F.when(F.col("access_count") == 0, 1)).alias("m"), F.count(ONE(1)).alias("t"))
    return (
        share(missing, "embedding_gap", 0.05, 0.2).unionByName(share(untagged, "untagged", 0.3, 0.6))
        .unionByName(share(orphans, "entity_orphans", 0.1, 0.3)).unionByName(share(unused, "never_accessed", 0.5, 0.9))
    )


def lint(memories: DataFrame, as_of: Column) -> DataFrame:
    """Rows (audit, id): records that break a rule of the store."""
    audit = lambda name, rows: rows.select(F.lit(name).alias("audit"), "id")
    parents = memories.where("NOT is_active").select(F.col("id").alias("parent_id"))
    targets = memories.select(F.col("id").alias("superseded_by"))
    return (
        audit("orphan_chunk", memories.where("is_active").join(parents, "parent_id", "left_semi"))
        .unionByName(audit("dangling_supersession", memories.where("superseded_by IS NOT NULL").join(targets, "superseded_by", "left_anti")))
        .unionByName(audit("superseded_but_active", memories.where("is_active AND superseded_by IS NOT NULL")))
        .unionByName(audit("expired_but_active", memories.where(F.col("is_active") & (F.col("expires_at") <= as_of))))
        .unionByName(audit("empty_content", memories.where("is_active AND length(trim(coalesce(content, ''))) = 0")))
    )


def recent_topics(memories: DataFrame, tags: DataFrame, as_of: Column, days: int = 7, limit: int = 50) -> DataFrame:
    recent = memories.where(F.col("is_active") & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))).select("id")
    counts = tags.join(recent, F.col("memory_id") == F.col("id"), "left_semi").groupBy("tag").agg(F.count(ONE(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "tag").limit(limit).select("tag", "n", F.least(ONE(3), F.ceil(F.col("n") / 5)).cast("int").alias("weight"))


def tag_lists(tags: DataFrame) -> DataFrame:
    return tags.groupBy("memory_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))


def counters(events: DataFrame, key: str, value: str) -> DataFrame:
    return events.groupBy(F.col(key).alias("key")).agg(F.sum(value).alias("value"))


def distinct_searches(access_log: DataFrame) -> DataFrame:
    minute = F.concat_ws(":", "query", F.date_format("accessed_at", "yyyy-MM-dd'T'HH:mm"))
    return access_log.where("query IS NOT NULL").groupBy(F.to_date("accessed_at").alias("date")).agg(F.count_distinct(minute).alias("searches"))


def document_library(memories: DataFrame) -> DataFrame:
    """Parents with how many active chunks they have."""
    chunks = memories.where("is_active AND parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(ONE(1)).alias("chunks"))
    return memories.where("is_active AND parent_id IS NULL").join(chunks, "id").select("id", "source_uri", "chunks")


def by_source_uri(memories: DataFrame) -> DataFrame:
    return memories.where("is_active AND source_uri IS NOT NULL").groupBy("source_uri").agg(F.count(ONE(1)).alias("count"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def tags_for(tags: DataFrame, ids: DataFrame) -> DataFrame:
    return tags.join(ids, F.col("memory_id") == F.col("id"), "left_semi").groupBy("tag").agg(F.count(ONE(1)).alias("count"))


def session_diff(memories: DataFrame, since: Column) -> DataFrame:
    new = F.col("created_at") >= since
    return memories.where("is_active").agg(
        F.count(F.when(new, 1)).alias("new_records"), F.count(F.when(~new & (F.col("updated_at") >= since), 1)).alias("updated_records"),
        F.count_distinct(F.when(new, F.col("session_id"))).alias("sessions"), F.count_distinct(F.when(new, F.col("agent"))).alias("agents"),
    )


def behavioural_audit(memories: DataFrame, as_of: Column, burst: int = 20) -> DataFrame:
    """Rows (anomaly, subject, n): bursts by agent and day, unusual importance, undated expiry, missing attribution, self-supersession."""
    rows = memories.where("is_active")
    row = lambda name, df: df.select(F.lit(name).alias("anomaly"), F.col("subject").cast("string").alias("subject"), F.col("n").cast("long").alias("n"))
    bursts = rows.groupBy("agent", F.to_date("created_at").alias("d")).agg(F.count(ONE(1)).alias("n")).where(F.col("n") >= burst).groupBy(F.col("agent").alias("subject")).agg(F.count(ONE(1)).alias("n"))
    high = rows.where("importance >= 0.95").groupBy(F.col("source").alias("subject")).agg(F.count(ONE(1)).alias("n"))
    expired = rows.where(F.col("expires_at") < as_of).groupBy(F.col("tier").alias("subject")).agg(F.count(ONE(1)).alias("n"))
    nobody = rows.where("agent IS NULL OR model_id IS NULL").groupBy(F.col("source").alias("subject")).agg(F.count(ONE(1)).alias("n"))
    frozen = rows.where(F.coalesce(F.get_json_object("metadata", "$.immutable") == "1", ONE(False)) & (F.col("updated_at") > F.col("created_at"))).groupBy(F.col("source").alias("subject")).agg(F.count(ONE(1)).alias("n"))
    return row("burst", bursts).unionByName(row("high_importance", high)).unionByName(row("expired", expired)).unionByName(row("unattributed", nobody)).unionByName(row("changed_immutable", frozen))
