"""One class with the operations a user of a record store calls, over tables of the record model.

Every method returns a DataFrame: reads return results, writes return the rows
or changes they propose, which ``apply`` or a sink puts into effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import security
from sparkloom.functions import text as X
from sparkloom.operators import analytics, evaluate, graph, knowledge, lifecycle, relational, search
from sparkloom.sources import ingest


class Store:
    """The tables by name (memories, memory_tags, memory_links, memory_entities, entities, …) and a time to refer to."""

    def __init__(self, tables: dict[str, DataFrame], as_of: Column) -> None:
        self.tables, self.as_of = tables, as_of

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def scored(self) -> DataFrame:
        return analytics.with_quality(self["memories"], self["memory_links"], self.as_of)

    # --- records ---

    def memory_store(self, rows: DataFrame) -> DataFrame:
        stored = self["memories"].where("is_active").select("content_type", X.content_hash(F.col("content")).alias("content_hash"))
        return knowledge.create(rows, stored, self.as_of)

    def memory_search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        return search.hybrid_search(queries, self.scored, self["embeddings"], self.as_of, limit, tags=self.tables.get("memory_tags"), links=self.tables.get("memory_links"))

    def memory_get(self, ids: DataFrame) -> DataFrame:
        return relational.in_order_of(ids, self["memories"])

    def memory_browse(self, where: Column, tags: list[str] | None = None, limit: int = 20) -> DataFrame:
        return relational.browse(self["memories"], self["memory_tags"], where, tags, limit)

    def memory_update(self, patch: DataFrame) -> DataFrame:
        return lifecycle.apply_changes(self["memories"], patch)

    def memory_forget(self, ids: DataFrame) -> dict[str, DataFrame]:
        children = {n: (self[n], "memory_id") for n in ("memory_tags", "memory_entities", "access_log") if n in self.tables}
        return lifecycle.delete_cascade(self["memories"], ids, children)

    def memory_context(self, queries: DataFrame, budget: int = 2000) -> DataFrame:
        found = self.memory_search(queries).groupBy("id").agg(F.max("score").alias("score"))
        return search.with_linked(found, self["memory_links"], self["memories"], budget)

    def memory_link(self, new: DataFrame) -> DataFrame:
        """Links with the given ones; of several for the same ends the last one in the input holds."""
        return new.unionByName(self["memory_links"].join(new, ["source_id", "target_id"], "left_anti"), allowMissingColumns=True)

    def memory_facts(self, subject: str | None = None) -> DataFrame:
        facts = self["memories"].where("is_active").select("id", F.inline(X.extract_spo(F.col("content"))))
        return facts.where(F.col("subject").ilike(f"%{subject}%")) if subject else facts

    def memory_entities(self, limit: int = 50) -> DataFrame:
        counts = relational.entity_counts(self["entities"], self["memory_entities"], self["memories"])
        return counts.where("memory_count > 0").orderBy(F.desc("memory_count"), "id").limit(limit)

    def memory_feedback(self, useful: DataFrame) -> DataFrame:
        """Records (id) with one more confirmation for each row."""
        counts = useful.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return self["memories"].join(counts, "id").select("id", (F.col("useful_count") + F.col("n")).alias("useful_count"))

    def memory_correct(self, pairs: DataFrame) -> DataFrame:
        """Records (id) replaced by others (superseded_by)."""
        return self.memory_update(pairs.select("id", "superseded_by", F.lit(False).alias("is_active")))

    # --- graph and overviews ---

    def memory_graph(self) -> DataFrame:
        nodes = self["relationships"].select(F.explode(F.array("source", "target")).alias("node")).distinct()
        return graph.graph_stats(self["relationships"], nodes)

    def memory_timeline(self, limit: int = 30) -> DataFrame:
        return analytics.timeline(self["memories"], limit)

    def memory_diff(self, since: Column) -> DataFrame:
        return relational.diff(self["memories"], since)

    def memory_navigate(self) -> DataFrame:
        lists = self["memory_tags"].groupBy(F.col("memory_id").alias("id")).agg(F.collect_set("tag").alias("tags"))
        return knowledge.palace(self["memories"], lists)

    def memory_wakeup(self) -> DataFrame:
        return knowledge.wake_up(self["memories"])

    def memory_compile(self) -> DataFrame:
        return knowledge.article(self["memories"])

    def memory_wiki_refresh(self, since: Column) -> DataFrame:
        changed = ingest.changed_since(self["memories"], since).select("namespace").distinct()
        return knowledge.article(self["memories"].join(changed, "namespace", "left_semi"))

    def memory_obsidian_sync(self, least: int = 5) -> DataFrame:
        groups = ingest.note_groups(self["memory_tags"], least)
        rows = self["memories"].where("is_active").join(groups, "id").select("note_group", "id", F.concat(F.lit("Record "), "id").alias("title"), "content")
        return ingest.render_notes(rows)

    # --- maintenance ---

    def memory_maintenance(self) -> dict[str, DataFrame]:
        """The changes that the nightly jobs propose, by job."""
        m = self["memories"]
        return {
            "expire": lifecycle.expire(m, self.as_of), "archive": lifecycle.archive_candidates(m, self.as_of), "importance": lifecycle.adjust_importance(self.scored, None, self.as_of),
            "tiers": lifecycle.promote_tiers(m, self["memory_tags"], self.as_of), "purge": lifecycle.purge_candidates(m, self.as_of), "recalibrate": lifecycle.recalibrate(m),
        }

    def memory_promote(self) -> DataFrame:
        return lifecycle.promote_tiers(self["memories"], self["memory_tags"], self.as_of)

    def memory_lint(self) -> DataFrame:
        return analytics.lint(self["memories"], self.as_of)

    def memory_job_health(self, days: int = 14) -> DataFrame:
        return analytics.job_health(self["job_outcomes"], self.as_of, days)

    def memory_contradictions(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of alike records with the reason why they contradict each other."""
        text = self["memories"].select("id", "content")
        rows = pairs.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b")
        return rows.select("a", "b", graph.contradiction_reason(F.col("ta"), F.col("tb")).alias("reason")).where("reason IS NOT NULL")

    def memory_security_audit(self) -> DataFrame:
        return analytics.behavioural_audit(self["memories"], self.as_of)

    def memory_ping(self) -> DataFrame:
        return analytics.store_stats(self["memories"], self["memory_tags"])

    # --- sources ---

    def memory_ingest(self, path: str) -> DataFrame:
        return ingest.read_markdown(self["memories"].sparkSession, path)

    def memory_clip(self, pages: DataFrame) -> DataFrame:
        """Chunks of stored pages whose address is allowed."""
        return ingest.page_chunks(pages.where(security.url_risk(F.col("url")) != "blocked"))

    def memory_auto(self, inputs: DataFrame) -> DataFrame:
        return inputs.withColumn("intent", X.intent(F.col("text")))

    # --- other stores ---

    def prediction(self) -> DataFrame:
        return analytics.calibration(self["predictions"])

    def goal(self, records: DataFrame) -> DataFrame:
        return knowledge.relevant_goals(records, self["goals"])

    def agent_task(self, limit: int = 20) -> DataFrame:
        return analytics.next_tasks(self["tasks"], limit)

    def diary_list_agents(self) -> DataFrame:
        return analytics.diary_agents(self["diary"])

    def diary_read(self, agent: str, limit: int = 10) -> DataFrame:
        return self["diary"].where(F.col("agent") == agent).orderBy(F.desc("created_at")).limit(limit)

    def embedding_models(self) -> DataFrame:
        return ingest.embedding_models(self["memories"].sparkSession)

    def memory_benchmark(self, n: int = 50) -> DataFrame:
        """Hit rates of records searched by their own words."""
        lists = self["memory_tags"].groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        made = evaluate.self_queries(self["memories"], lists, n)
        found = search.top(search.two_pass_fts(made, self["memories"].where("is_active")), 10)
        return evaluate.hit_rates(found, made.select("query_id", F.col("query_id").alias("id"), F.lit(1).alias("grade")))
