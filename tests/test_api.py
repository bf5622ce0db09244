"""The store's methods run over the record model."""

import pytest
from pyspark.sql import functions as F

from sparkloom.api import Store
from sparkloom.plans.registry import Tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    t = Tables(spark, DATA)
    names = ("memories", "memory_tags", "memory_links", "memory_entities", "entities", "access_log", "job_outcomes", "predictions", "tasks", "relationships")
    tables = {n: getattr(t, n) for n in names} | {"embeddings": t.embeddings.select(F.col("vec_id").alias("id"), "embedding")}
    return Store(tables, t.as_of)


@pytest.mark.parametrize("name", ["memory_entities", "memory_facts", "memory_timeline", "memory_navigate", "memory_wakeup", "memory_compile", "memory_obsidian_sync", "memory_promote", "memory_lint", "memory_job_health", "memory_security_audit", "memory_ping", "prediction", "agent_task", "embedding_models"])
def test_reads(store, name):
    assert getattr(store, name)().schema.fields
    getattr(store, name)().limit(3).collect()


def test_writes(spark, store):
    new = spark.createDataFrame([(1_000_000, "We decided to use docker. " * 8, "note", "manual", ["A b"], 0.5), (1_000_001, "short", "note", "manual", [], 0.5)], "id long, content string, content_type string, source string, tags array<string>, importance double")
    rows = store.memory_store(new.withColumn("created_at", store.as_of)).collect()
    assert [(r.id, r.tags, r.quality_score) for r in rows] == [(1_000_000, ["a-b"], 0.3)]
    gone = spark.createDataFrame([(1,), (2,)], "id long")
    assert store.memory_forget(gone)["table"].where("id IN (1, 2)").count() == 0
    assert store.memory_feedback(gone).count() == 2
    jobs = store.memory_maintenance()
    assert set(jobs) == {"expire", "archive", "importance", "tiers", "purge", "recalibrate"}
    assert store.memory_contradictions(spark.createDataFrame([(1, 2)], "a long, b long")).count() <= 1
