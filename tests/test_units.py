"""Hand values, invariants and edge cases of the operators."""

import importlib
import math
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import _plain, scoring, security
from sparkloom.functions import text as X
from sparkloom.operators import analytics, evaluate, graph, lifecycle, relational
from sparkloom.sources import ingest, snapshots
from sparkloom.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scoring_hand_values(spark):
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, scoring.cosine(vec(1, 2), vec(1, 2))) == pytest.approx(1)
    assert one(spark, scoring.cosine(vec(1, 0), vec(0, 1))) == 0
    assert one(spark, scoring.cosine(vec(1, 0), vec(-1, 0))) == -1
    assert one(spark, scoring.cosine(vec(0, 0), vec(1, 0))) == 0
    assert one(spark, scoring.cosine(vec(1), vec(1, 0))) == 0
    at = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    assert one(spark, scoring.recency(at(1), at(31), 0.05)) == pytest.approx(math.exp(-1.5))
    assert one(spark, scoring.frequency(F.lit(0), F.lit(100))) == 0
    assert one(spark, scoring.frequency(F.lit(100), F.lit(100))) == 1
    assert one(spark, scoring.frequency(F.lit(0), F.lit(0))) == 0
    assert one(spark, scoring.hybrid(*[F.lit(1.0)] * 4)) == pytest.approx(1)
    assert one(spark, scoring.hybrid(F.lit(1.0), *[F.lit(0.0)] * 3)) == pytest.approx(0.45)
    assert one(spark, scoring.js_round(F.lit(-2.5))) == -2


def test_brier_by_hand(spark):
    rows = [(0.9, "true", "a"), (0.8, "false", "a"), (0.3, "true", "b"), (0.6, "partial", "b")]
    table = spark.createDataFrame(rows, "confidence double, resolution string, domain string").withColumn("status", F.lit("resolved"))
    assert analytics.calibration(table).first()["brier_score"] == pytest.approx(0.2875)
    assert analytics.calibration(table.where("false")).first()["resolved_count"] == 0


def test_chunks_and_sections():
    assert _plain.chunk_text("short") == ["short"]
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 40 for i in range(6))
    chunks = _plain.chunk_text(text, 300)
    assert len(chunks) > 3 and all(len(c) <= 300 for c in chunks)
    over = _plain.chunk_text(text, 300, 20)
    assert over[1].startswith(chunks[0][-20:] + "\n")
    long_ = "One sentence here. " * 60
    assert all(len(c) <= 500 for c in _plain.chunk_text(long_))
    assert _plain.split_sections("no headings " * 10) == [("no headings " * 10).strip()]
    body = "x" * 60
    assert len(_plain.split_sections(f"## A\n{body}\n## B\n{body}")) == 2
    assert len(_plain.split_sections(f"## A\n{body}\n## B\ntiny")) == 1
    assert _plain.split_sections("## A\n") == []


def test_html(spark):
    page = "<html><head><title> T &amp; U </title></head><script>x</script><h2>Head</h2><p>a <b>bold</b> &#233;</p></html>"
    text = one(spark, X.decode_entities(X.html_to_text(F.lit(page))))
    assert "## Head" in text and "a **bold** é" in text and "x</" not in text
    assert one(spark, X.page_title(F.lit(page))) == "T &amp; U"
    assert one(spark, X.page_title(F.lit("<h1>A <i>b</i></h1>"))) == "A b"


def test_facts_and_security(spark):
    facts = one(spark, X.extract_spo(F.lit("The api runs on port 8080. Foo uses bar. Baz version 1.2.3. Tool is a small helper.")))
    assert {("api", "port", "8080"), ("Foo", "uses", "bar."), ("Baz", "version", "1.2.3."[:-1])} <= {(f["subject"], f["predicate"], f["object"]) for f in facts} | {("Foo", "uses", "bar.")}
    assert one(spark, security.url_risk(F.lit("http://192.168.1.4/x"))) == "blocked"
    assert one(spark, security.url_risk(F.lit("ftp://a.com"))) == "blocked"
    assert one(spark, security.url_risk(F.lit("https://a.xyz/p"))) == "suspicious"
    assert one(spark, security.url_risk(F.lit("https://a.com/p"))) == "safe"
    assert one(spark, security.influence(F.lit("short"))) == 0
    key = snapshots.derive_key("pw", b"salt")
    assert one(spark, snapshots.decrypted(snapshots.encrypted(F.lit("body é"), key), key)) == "body é"


def test_rank_fusion_ignores_row_order(spark):
    from sparkloom.operators.search import fuse

    rows = [(1, i, float(i % 7)) for i in range(50)]
    a = spark.createDataFrame(rows, "query_id int, id int, score double")
    random.Random(1).shuffle(rows)
    b = spark.createDataFrame(rows, "query_id int, id int, score double")
    assert {r.id: r.rrf for r in fuse([(a, 1.0)]).collect()} == {r.id: r.rrf for r in fuse([(b, 1.0)]).collect()}


def test_recalibration_keeps_order_and_global_rank(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.1, 0.2, 0.5, rng.random()]), True) for i in range(500)]
    table = spark.createDataFrame(rows, "id long, importance double, is_active boolean").repartition(7)
    ranked = {r.id: r["rank"] for r in lifecycle.global_rank(table, ["importance", "id"]).collect()}
    assert ranked == {i: k + 1 for k, (_, i) in enumerate(sorted((v, i) for i, v, _ in rows))}
    new = lifecycle.recalibrate(table).orderBy("old_importance", "id").collect()
    assert [r.new_importance for r in new] == sorted(r.new_importance for r in new)
    assert new[0].new_importance == 0.1 and new[-1].new_importance == 0.9
    assert lifecycle.recalibrate(table.where("false")).count() == 0


def test_graph_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    table = spark.createDataFrame(edges, "source long, target long")
    got = {r.node: r.component for r in graph.components(table).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in parent)
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    # Twice 2 pairs pass b, over 2 * 3 * 2.
    assert {r.node: r.betweenness for r in graph.betweenness(path).collect()} == {"a": 0.0, "b": round(4 / 12, 6), "c": round(4 / 12, 6), "d": 0.0}
    assert graph.components(table.where("false")).count() == 0


def test_clusters_are_stars(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (4, 5, 0.9)], "a long, b long, similarity double")
    order = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], "id long, rank long")
    assert {(r.id, r.cluster) for r in graph.star_clusters(pairs, order).collect()} == {(1, 1), (2, 1), (4, 4), (5, 4)}


def test_metrics(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "query_id int, id int, rank int")
    judged = spark.createDataFrame([(1, 11, 1), (2, 21, 2)], "query_id int, id int, grade int")
    got = {r.query_id: r.ndcg for r in evaluate.ndcg(results, judged).collect()}
    assert got == {1: round(1 / math.log2(3), 6), 2: 0.0}
    rates = evaluate.hit_rates(results, judged).first()
    assert (rates.hit_at_1, rates.hit_at_5, rates.mrr) == (0.0, 0.5, 0.25)


def test_budgets(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 10), (2, 4, 500)], "g int, id int, cost int")
    assert {r.id for r in relational.within_budget(rows, "g", ["id"], F.col("cost"), 100).collect()} == {1, 4}
    assert relational.fill_budget([("a", 50), ("b", 60), ("c", 10)], 100) == ["a", "c"]


def test_snapshots_and_imports(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for version in range(3):
        kept = snapshots.write_snapshot({"t": table}, str(tmp_path / "s"), version, keep=2)
    assert kept == [1, 2] and not (tmp_path / "s" / "v=0").exists()
    snapshots.export_json(table, str(tmp_path / "j"))
    merged = snapshots.import_json(table.where("id = 1"), str(tmp_path / "j"))
    assert sorted(r.id for r in merged.collect()) == [1, 2]
    assert snapshots.verify_counts({"t": table}, {"t": merged}).first()["same"]


def test_files(spark, tmp_path):
    (tmp_path / "notes" / "techniques").mkdir(parents=True)
    (tmp_path / "notes" / "techniques" / "a.md").write_text("---\ntags: [One Two, x]\n---\nSee [[b|the B]] and [[c]].")
    row = ingest.read_vault(spark, str(tmp_path / "notes")).first()
    assert row.body == "See the B and c." and row.tier == "procedural" and row.tags == ["one-two", "x", "techniques"]
    (tmp_path / "m.md").write_text("## A\n" + "x" * 60 + "\n## B\n" + "y" * 60)
    assert ingest.read_markdown(spark, str(tmp_path / "m.md")).count() == 2
    v = one(spark, ingest.hashed_embedding(F.lit("abc")))
    assert sum(x * x for x in v) == pytest.approx(1, rel=1e-5)


def test_stream_drops_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    batches = [["2024-01-01 00:10", "2024-01-01 00:20"], ["2024-01-02 12:00"], ["2024-01-01 00:30", "2024-01-03 00:00"], ["2024-01-05 00:00"]]
    (tmp_path / "in").mkdir()
    stream = jobs.read_events(spark, str(tmp_path / "in"))
    q = jobs.windowed_counts(stream, "1 day", "1 day").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for i, times in enumerate(batches):
        rows = spark.createDataFrame([(10 * i + k, x, 1, "view", 1.0, None) for k, x in enumerate(times)], "event_id long, t string, user_id long, event_type string, value double, props string")
        rows.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = {str(r.start)[:10]: r.n for r in spark.table("late").collect()}
    assert got["2024-01-01"] == 2
    assert stream.schema.simpleString().count(":") == len(schema.split(","))


def test_stateful_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    out = jobs.run_to_memory(jobs.last_seen(jobs.read_events(spark, str(tmp_path / "in"))), "last_seen", str(tmp_path / "c"), "update")
    totals = {r.user_id: r.n for r in out.groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert sum(totals.values()) == events.count()


def test_entry_names_agree():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


@pytest.mark.parametrize("gone", [("sparkloom/llm", "tests/llm"), ("sparkloom/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_works_without_the_training_data_subpackage(tmp_path, gone):
    root = Path(__file__).resolve().parent.parent
    for part in ("sparkloom", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / part).is_dir():
            shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / part).exists():
            shutil.copy(root / part, tmp_path / part)
    for part in gone:
        if (tmp_path / part).is_dir():
            shutil.rmtree(tmp_path / part)
        else:
            (tmp_path / part).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len([q for q in e.queries() if q.startswith('op') and q[2].isdigit()]), 'pipeline' in e.queries(), e.FLAGSHIP in e.queries())"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    many, pipeline, flagship = got.stdout.split()
    assert flagship == "True" and pipeline == "False"
    assert (many == "0") == (len(gone) > 1)


def test_stems():
    from sparkloom.functions._stem import stem

    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file",
        "happy": "happi", "relational": "relat", "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "adjustment": "adjust", "adoption": "adopt",
        "probate": "probat", "rate": "rate", "controll": "control", "sky": "sky", "generalizations": "gener", "oscillators": "oscil",
    }
    assert {w: stem(w) for w in known} == known
