"""Retrieval evaluation over ranked lists: (query_id, id, rank) against (query_id, id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dcg(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ndcg(results: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of queries with judgments, gain 2^grade - 1."""
    from pyspark.sql import Window

    hits = results.where(F.col("rank") <= k).join(judged, ["query_id", "id"])
    found = hits.groupBy("query_id").agg(F.sum(_dcg(F.col("grade"), F.col("rank"))).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = judged.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(_dcg(F.col("grade"), F.col("r"))).alias("ideal"))
    share = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return ideal.join(found, "query_id", "left").select("query_id", F.round(share, 6).alias("ndcg"))


def hit_rates(results: DataFrame, judged: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: share of queries with any hit at each cut, and the mean reciprocal rank of the first hit."""
    queries = judged.select("query_id").distinct()
    first = results.join(judged.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = queries.join(first, "query_id", "left")
    rates = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{k}") for k in cuts]
    return rows.agg(F.count(F.lit(1)).alias("queries"), *rates, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def overlap(baseline: Column, current: Column, live: Column, k: int = 10) -> Column:
    """(overlap, exact, avg_shift, churned) of two id arrays; ids no longer alive are left out of the baseline."""
    b, c = F.slice(baseline, 1, k), F.slice(current, 1, k)
    kept = F.filter(b, lambda x: F.array_contains(live, x))
    n = F.greatest(F.lit(1), F.size(kept))
    both = F.filter(c, lambda x: F.array_contains(kept, x))
    shift = F.aggregate(both, F.lit(0).cast("long"), lambda acc, x: acc + F.abs(F.array_position(kept, x) - F.array_position(c, x)))
    return F.struct(
        F.round(F.size(both) / n, 6).alias("overlap"), (kept == c).alias("exact"),
        F.round(F.when(F.size(both) > 0, shift / F.size(both)).otherwise(n.cast("double")), 6).alias("avg_shift"), (F.size(b) - F.size(kept)).alias("churned"),
    )


def regression(baselines: DataFrame, runs: DataFrame, live_ids: DataFrame, k: int = 10, least_overlap: float = 0.8, most_shift: float = 3.0) -> DataFrame:
    """Each query's current ids against its baseline, with an alert; live ids are looked up by a join, not collected."""
    exploded = baselines.select("query", F.explode("ids").alias("id")).join(live_ids, "id", "left_semi")
    live = exploded.groupBy("query").agg(F.collect_set("id").alias("live"))
    rows = baselines.withColumnRenamed("ids", "old").join(runs.withColumnRenamed("ids", "new"), "query").join(live, "query", "left")
    compared = rows.select("query", overlap(F.col("old"), F.col("new"), F.coalesce("live", F.array().cast("array<bigint>")), k).alias("o")).select("query", "o.*")
    return compared.withColumn("alert", (F.col("overlap") < least_overlap) | (F.col("avg_shift") > most_shift))


def adaptive_thresholds(history: DataFrame, base_overlap: float = 0.8, base_shift: float = 3.0, last: int = 7) -> DataFrame:
    """Thresholds of queries with at least three runs: the base if they were stable, else from their medians."""
    from pyspark.sql import Window

    recent = history.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("r") <= last)
    middle = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(F.lit(1)) / 2).cast("int"))
    m = recent.groupBy("query").agg(F.count(F.lit(1)).alias("runs"), middle("overlap").alias("o"), middle("shift").alias("s")).where("runs >= 3")
    stable = F.col("o") >= 0.95
    return m.select(
        "query", F.when(stable, base_overlap).otherwise(F.greatest(F.lit(0.5), F.col("o") - 0.15)).alias("min_overlap"), F.when(stable, base_shift).otherwise(F.col("s") + 1.5).alias("max_shift")
    )


def self_query(content: Column, tags: Column) -> Column:
    """Words that should find a record again: from the middle of its first line of prose, else its tags, else its beginning."""
    prose = F.filter(F.split(content, "\n"), lambda x: (F.length(F.trim(x)) > 20) & ~F.trim(x).rlike(r"^[#*-]"))
    line = F.trim(F.get(prose, F.lit(0)))
    words = F.split(line, r"\s+")
    middle = F.array_join(F.slice(words, F.floor(F.size(words) / 4).cast("int") + 1, 5), " ")
    return (
        F.when(line.isNotNull() & (F.size(words) > 6), middle).when(line.isNotNull(), F.substring(line, 1, 60))
        .when(F.size(tags) > 0, F.array_join(F.slice(tags, 1, 3), " ")).otherwise(F.trim(F.substring(content, 1, 40)))
    )


def self_queries(memories: DataFrame, tag_lists: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """(query_id, query) of active records, or of a sample of n of them, each of which should find its record."""
    from sparkloom.operators.relational import sample

    rows = memories.where("is_active")
    rows = sample(rows, n, seed) if n else rows
    rows = rows.join(tag_lists.select("id", "tags"), "id", "left")
    return rows.select(F.col("id").alias("query_id"), self_query(F.col("content"), F.coalesce("tags", F.array().cast("array<string>"))).alias("query"))


def tune(signals: DataFrame, judged: DataFrame, weights: dict[str, float], steps: tuple[float, ...] = (0.5, 0.75, 1.25, 1.5), rounds: int = 2, held_out: float = 0.2) -> tuple[dict[str, float], float, float]:
    """(weights, NDCG on the queries tuned on, NDCG on those held out) by coordinate descent.

    ``signals`` has query_id, id and one column for each weight; a row's score
    is their weighted sum. No search runs again: all steps of one weight are
    tried in one pass over the signals, and one mean for each of them reaches
    the driver. Queries are held out by their hash.
    """
    from pyspark.sql import Window

    out = F.pmod(F.xxhash64("query_id"), F.lit(1000)) < int(held_out * 1000)

    def means(trials: list[dict[str, float]], test: bool) -> list[float]:
        part = lambda df: df.where(out if test else ~out)
        scores = F.array(*[sum((F.col(name) * w for name, w in trial.items()), F.lit(0.0)) for trial in trials])
        rows = part(signals).select("query_id", "id", F.posexplode(scores).alias("trial", "score"))
        order = Window.partitionBy("trial", "query_id").orderBy(F.desc(F.round("score", 9)), "id")
        ranked = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
        own = F.concat_ws(":", "trial", "query_id")
        graded = part(judged).select("query_id", "id", "grade", F.explode(F.array(*[F.lit(i) for i in range(len(trials))])).alias("trial"))
        found = ndcg(ranked.withColumn("query_id", own), graded.withColumn("query_id", own))
        by_trial = found.groupBy(F.substring_index("query_id", ":", 1).cast("int").alias("trial")).agg(F.avg("ndcg").alias("m"))
        value = {r["trial"]: r["m"] for r in by_trial.collect()}  # one row for each trial
        return [value.get(i, 0.0) for i in range(len(trials))]

    best = means([weights], False)[0]
    for _ in range(rounds):
        before = best
        for name in sorted(weights):
            trials = [weights | {name: round(weights[name] * step, 6)} for step in steps]
            value, trial = max(zip(means(trials, False), trials, strict=True), key=lambda x: x[0])
            if value > best + 1e-9:
                best, weights = value, trial
        if best == before:
            break
    return weights, best, means([weights], True)[0]


def compare_run(baselines: DataFrame, runs: DataFrame, run_id: str, live_ids: DataFrame, k: int = 10, least_overlap: float = 0.8, most_shift: float = 3.0) -> DataFrame:
    """The latest ids of each query against those it had in an earlier run, with an alert; columns as in ``regression``.

    ``baselines`` (query, ids) are the current ids, ``runs`` (run_id, query, ids) the stored ones; queries without a row in that run are left out.
    """
    old = runs.where(F.col("run_id") == run_id).select("query", "ids")
    return regression(old, baselines, live_ids, k, least_overlap, most_shift)


def promote(baselines: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """Baselines (query, ids) in which the queries of a run have its ids, new ones added."""
    new = runs.where(F.col("run_id") == run_id).select("query", "ids")
    return baselines.join(new, "query", "left_anti").select("query", "ids").unionByName(new)


def reset(baselines: DataFrame, queries: list[str] | None = None) -> DataFrame:
    """Baselines without those of some queries, or without any."""
    return baselines.where(~F.col("query").isin(queries) if queries is not None else F.lit(False))


def judge_scores(answers: DataFrame) -> DataFrame:
    """Mean of each judged dimension and overall, from rows (question, dimension, score)."""
    return answers.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))
