"""What jobs move between tasks: with the rows, not with the pairs; and the same results as the plain rules."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import security as Z
from sparkloom.functions import text as X
from sparkloom.operators import graph as G
from sparkloom.operators import knowledge as K
from sparkloom.operators import relational as L
from sparkloom.operators import search as R
from sparkloom.operators.shared import shared_graph
from sparkloom.plans import q_text, registry  # noqa: F401
from sparkloom.sources import ingest as I


@pytest.fixture
def moved(spark):
    """Runs a plan; gives its rows, and how many rows all its stages wrote for others."""
    sc = spark.sparkContext

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._gateway.new_array(sc._jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def run(plan):
        before = written()
        rows = plan().collect()
        return rows, written() - before

    return run


def test_many_queries_move_their_best_documents_not_all_pairs(spark, moved):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)] + ["ähre", "rare"]
    docs = spark.createDataFrame([(i, " ".join(["common", *rng.choices(words, k=rng.randint(0, 9))]) if i % 50 else None) for i in range(600)], "id long, content string").repartition(3)
    queries = [(q, " ".join(["common", *rng.sample(words, q % 6)])) for q in range(120)] + [(200, "nothing here"), (201, ""), (202, "common w1 w2 absent")]
    queries = spark.createDataFrame(queries, "query_id long, query string")
    got, rows = moved(lambda: R.two_pass_fts(queries, docs))
    want = R.two_pass_fts(queries, docs, many_queries=1 << 30).collect()
    assert {(r.query_id, r.id): r.score for r in got} == pytest.approx({(r.query_id, r.id): r.score for r in want}, abs=2e-9)
    assert len(got) == len(want) > 120 * 200
    # All pairs of a query and a document share a word: 120 x 588.
    assert rows < 120 * 588


def test_graph_of_shared_items_moves_lists_not_pairs(spark, moved):
    rng = random.Random(2)
    rows = [(f"i{i}", n) for i in range(60) for n in rng.sample(range(-20, 180), rng.randint(1, 60))] + [("same", 5), ("same", 5), (None, 7), ("alone", 999)]
    rows += [("all", n) for n in range(-1, 2100)]
    bridge = spark.createDataFrame(rows, "item string, node long").repartition(3)
    pairs = bridge.join(bridge.withColumnRenamed("node", "target"), "item").where("node < target").select(F.col("node").alias("source"), "target").distinct()
    graph, moves = moved(lambda: Collected(shared_graph(bridge)))
    assert moves < sum(n * (n - 1) // 2 for n in bridge.where("item IS NOT NULL").groupBy("item").count().toPandas()["count"]) / 10
    assert {tuple(r) for r in graph.got.degrees().collect()} == {tuple(r) for r in G.degrees(pairs).collect()}
    some = bridge.where("item <> 'all'")
    pairs = some.join(some.withColumnRenamed("node", "target"), "item").where("node < target").select(F.col("node").alias("source"), "target").distinct()
    want = {tuple(r) for r in G.communities(pairs, 3).collect()}
    assert {tuple(r) for r in shared_graph(some).communities(3).collect()} == want and len(want) > 100


class Collected:
    """What was built before, for ``moved``."""

    def __init__(self, got) -> None:
        self.got = got

    def collect(self):
        return self


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_influence_is_worked_out_once(spark):
    plan = optimized(registry.QUERIES["z3_influence"](spark, "/root/testdata/sf0.001"))
    # Once for documents and once for turns.
    assert plan.count("(?:you (?:must|should|need to") == 2


def test_each_influence_pattern_needs_its_words():
    phrases = """whenever you see it you should act|When you handle this, always|remember to always|don't forget to never|treat it as|consider all of it as|interpret that as|the correct way is to|the best approach is to
the proper method is to|update your rules|update your understanding|add this to your knowledge|prioritize this over|prefer a over|favor b over|as an expert|as authority|as a senior|as lead|as a principal|as staff|according to official
according to internal|this is the official policy|this is canonical directive|I am authorized by|I was told to|I was instructed by|management has decided|leadership requires|the team mandates|security team has directs|immediately|urgently
right now|as soon as possible|ASAP|without delay|time-sensitive|time critical|do this first|do this before|stop everything|stop what you're doing|this is an emergency|this requires urgent|failure to act will result|the only solution is
the best approach is|the optimal tool is|the preferred framework is|the superior library is|the recommended platform is|you should always recommend|you should use|never recommend that thing|never use it all|is deprecated.|is obsolete,|is dangerous and
is insecure.|is harmful —|you must|you are required to|you have to|always|never|do not ever|make sure to always|ensure you always|from now on|going forward|henceforth|from this point|it is critical that you|it is vital to""".replace("\n", "|").split("|")
    kinds = {"imperative": Z._IMPERATIVE} | {kind: patterns for kind, _, _, patterns in Z.INFLUENCE}
    tried = set()
    for kind, patterns in kinds.items():
        for p, needed in zip(patterns, Z._NEEDED[kind], strict=True):
            for text in (x for phrase in phrases for x in (phrase, phrase.upper())):
                if re.search(p, text, re.A):
                    tried.add(p)
                    assert any(w in text.lower() for w in needed), (p, text)
    assert len(tried) == sum(len(p) for p in kinds.values())


def test_sentences_of_a_contradiction_are_cut_once(spark):
    texts = spark.createDataFrame([("The sky is blue today. x", "The sky is not blue today. y")], "a string, b string")
    plan = optimized(texts.select(G.contradiction_reason(F.col("a"), F.col("b")).alias("reason")))
    assert plan.count("no longer") == 2


def test_cross_links_compare_sets_of_tags(spark, moved):
    rng = random.Random(3)
    tags = {i: set(rng.sample("abcdef", rng.randint(1, 4))) if i < 900 else set(rng.sample([f"t{k}" for k in range(40)], 5)) for i in range(1000)}
    rows = spark.createDataFrame([(i, t) for i, own in tags.items() for t in own], "memory_id long, tag string").repartition(3)
    got, rows_moved = moved(lambda: I.cross_links(rows, rows.where("memory_id % 3 = 0"), most=7))
    want = set()
    for a in range(0, 1000, 3):
        others = sorted((-len(tags[a] & tags[b]), b) for b in tags if b != a and len(tags[a] & tags[b]) >= 2)
        want |= {(a, b, r) for r, (_, b) in enumerate(others[:7], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    pairs = sum(len(tags[a] & tags[b]) for a in range(0, 1000, 3) for b in tags if a != b)
    assert rows_moved < pairs / 4


def moments(spark, rng, n):
    """Records at random microseconds of two hours or of few of them, some before 1970, some without a time or inactive."""
    at = [rng.choice([rng.randrange(7_200_000_000), rng.randrange(30) * 300_000_000, -rng.randrange(3_600_000_000)]) for _ in range(n)]
    rows = [(i, None if i % 97 == 5 else u, i % 11 != 3, round(rng.random(), 1)) for i, u in enumerate(at)]
    made = spark.createDataFrame(rows, "id long, u long, is_active boolean, importance double").repartition(3)
    return rows, made.withColumn("created_at", F.timestamp_micros("u"))


def test_temporal_neighbours_meet_moments_not_records(spark, moved):
    rows, made = moments(spark, random.Random(4), 1500)
    got, rows_moved = moved(lambda: L.temporal_neighbours(made.where("id % 4 < 2"), made, 1, 4))
    want, pairs = set(), 0
    for i, u, _, _ in rows:
        if i % 4 < 2 and u is not None:
            near = sorted((abs(v - u), j) for j, v, live, _ in rows if live and v is not None and j != i and abs(v - u) <= 3_600_000_000)
            pairs += len(near)
            want |= {(i, j, r, gap / 1e6) for r, (gap, j) in enumerate(near[:4], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert rows_moved < pairs / 8


def test_preceding_days_are_put_together_of_blocks(spark, moved):
    rng = random.Random(5)
    rows = [(i, rng.choice([rng.randrange(-3 * 86_400_000_000, 20 * 86_400_000_000), rng.randrange(20) * 86_400_000_000]), round(rng.random(), 1)) for i in range(1600)]
    made = spark.createDataFrame(rows, "id long, u long, importance double").repartition(3).withColumn("created_at", F.timestamp_micros("u"))
    got, rows_moved = moved(lambda: L.preceding_week(made.where("id % 4 = 0"), made.where("id % 4 > 0"), 7, 6))
    want, pairs = set(), 0
    for i, t, _ in rows[::4]:
        near = sorted((-w, j) for j, u, w in rows if j % 4 and t - 7 * 86_400_000_000 <= u < t)
        pairs += len(near)
        want |= {(i, j, r) for r, (_, j) in enumerate(near[:6], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    # Without any two alike, these few records make more rows of blocks than pairs; of equal moments, far fewer.
    same = made.withColumn("created_at", F.date_trunc("day", "created_at"))
    _, few = moved(lambda: L.preceding_week(same.where("id % 4 = 0"), same.where("id % 4 > 0"), 7, 6))
    assert few < pairs / 4


def test_goals_with_the_same_keywords_are_met_once(spark, moved):
    rng = random.Random(6)
    titles = {g: " ".join(rng.sample(["grow", "edge", "ring", "bolt", "the", "an"], rng.randint(1, 4))) for g in range(300)} | {300: "the", 301: ""}
    texts = {i: " ".join(rng.choices(["grow", "edge", "ring", "bolt", "other", "The"], k=4)) if i % 20 else None for i in range(400)}
    goals = spark.createDataFrame([(g, title, "active" if g % 7 else "done") for g, title in titles.items()], "id long, title string, status string").repartition(3)
    records = spark.createDataFrame(list(texts.items()), "id long, content string").repartition(3)
    got, rows_moved = moved(lambda: K.relevant_goals(records, goals, 0.3))
    want = {}
    for i, text in texts.items():
        for g, title in titles.items():
            keys = {w for w in title.split() if len(w) >= 3 and w not in X.STOPWORDS}
            share = len(keys & {w.lower() for w in (text or "").split()}) / max(1, len(keys))
            if g % 7 and share >= 0.3:
                want[i, g] = round(share, 6)
    assert {(r.id, r.goal_id): r.share for r in got} == want and len(got) == len(want)
    assert rows_moved < len(want) / 4


@pytest.mark.parametrize("hot", [3, 10_000])
def test_words_of_an_entity_move_by_record(spark, moved, monkeypatch, hot):
    monkeypatch.setattr(K, "HOT", hot)
    rng = random.Random(7)
    vocabulary = [f"word{k}" for k in range(30)]
    texts = {i: rng.sample(vocabulary, rng.randint(0, 12)) for i in range(200)}
    bridge = [(i, e) for i in range(210) for e in rng.sample(range(40), 3)]
    memories = spark.createDataFrame([(i, " ".join(w) if i % 30 else None, i % 9 > 0) for i, w in texts.items()], "id long, content string, is_active boolean").repartition(3)
    made = spark.createDataFrame(bridge, "memory_id long, entity_id long").repartition(3)
    entities = spark.range(45).select("id")
    got, rows_moved = moved(lambda: K.entity_profiles(entities, made, memories))
    want = {}
    for e in range(45):
        own = [i for i, x in bridge if x == e and i in texts and i % 9]
        n = Counter(w for i in own if i % 30 for w in texts[i])
        if own:
            want[e] = (len(own), ",".join(sorted(n, key=lambda w: (-n[w], w))[:5]) or None)
    assert {r.entity_id: (r.records, r.words) for r in got} == want
    if hot > 3:
        assert rows_moved < sum(len(texts.get(i, ())) for i, _ in bridge)
