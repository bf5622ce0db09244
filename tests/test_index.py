"""Vector index, posting lists, clusters, entity proximity, deep search, imports and credits against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions._regex import ascii_bounds
from sparkloom.operators import graph as G
from sparkloom.operators import search as R
from sparkloom.operators import vectors as V
from sparkloom.operators.postings import build_postings
from sparkloom.sources import imports as I


def vectors(n, d=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 3
    return (centres[rng.integers(groups, size=n)] + rng.normal(size=(n, d))).round(4)


def best(v, q, k):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit[q], 9)
    order = sorted((-s[i], i) for i in range(len(v)) if i != q)[:k]
    return [i for _, i in order]


def test_vector_index(spark, tmp_path):
    v = vectors(1500)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, [0.0] * 16), (9003, [1.0, 2.0]), (9004, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = V.build_index(df, f"{tmp_path}/index", cells=24)
    asked = df.where("id % 50 = 0 OR id = 9003").select(F.col("id").alias("query_id"), "embedding")
    exact = index.nearest(asked, 10, probes=2, itself=False)
    got = {}
    for r in exact.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got.pop(9003) == [9004]
    assert got == {q: best(v, q, 10) for q in range(0, 1500, 50)}
    # Few cells only: most of the nearest rows are there.
    near = index.nearest(asked, 10, probes=4, exact=False, itself=False).where("query_id < 9000").groupBy("query_id").agg(F.collect_set("id").alias("ids")).collect()
    recall = np.mean([len(set(best(v, r.query_id, 10)) & set(r.ids)) / 10 for r in near])
    assert recall >= 0.9
    pairs = {(r.query_id, r.id) for r in V.open_index(spark, f"{tmp_path}/index").within(asked, 0.8, block=7).where("query_id < 9000").collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    assert pairs == {(q, int(i)) for q in range(0, 1500, 50) for i in np.flatnonzero(s[q] >= 0.8)}
    skipped = [len(np.flatnonzero(index.bounds(unit[q]) >= 0.8)) for q in range(0, 1500, 50)]
    assert np.mean(skipped) < 12  # of 24 cells
    scanned = {(r.query_id, r.id) for r in V.scan(asked, df, 0.8, block=11).where("query_id < 9000").collect()}
    assert scanned == pairs


def docs(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [(i * 7, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randrange(1, 40)))) for i in range(n)]


def test_posting_lists_follow_changes(spark, tmp_path):
    rows = docs(3000)
    df = spark.createDataFrame([*rows, (50_000, None), (50_001, "")], "id long, content string")
    lists = build_postings(df, f"{tmp_path}/a")
    asked = spark.createDataFrame([(1, "w5 w80 w200"), (2, "w0 w1"), (3, "nothing"), (4, "w299")], "query_id long, query string")
    terms = asked.select("query_id", F.explode(F.split("query", " ")).alias("term"))

    def same(lists, df):
        a = {tuple(r) for r in R.top(R.bm25(terms, df), 20).select("query_id", "id", "score").collect()}
        assert a == {tuple(r) for r in lists.best(terms, 20).select("query_id", "id", "score").collect()} and a
        assert {tuple(r) for r in R.two_pass_fts(asked, df).collect()} == {tuple(r) for r in R.two_pass_fts(asked, lists).collect()}

    same(lists, df)
    changed = spark.createDataFrame([(7, "w200 w200 w5"), (99_999, "w299 w80 new")], "id long, content string")
    gone = spark.createDataFrame([(14,), (21,)], "id long")
    later = lists.update(changed, gone)
    now = df.join(gone, "id", "left_anti").join(changed.select("id"), "id", "left_anti").unionByName(changed)
    same(later, now)
    packed = later.compact(f"{tmp_path}/b")
    same(packed, now)
    assert packed.versions == 1
    # Only buckets of the terms are opened.
    plan = lists.blocks(terms.select(F.col("term").alias("w")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]


@pytest.mark.parametrize(("least", "finish"), [(2, 0), (3, 0), (2, 10**6)])
def test_clusters_equal_the_sequential_rule(spark, least, finish):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(200), 2))) for _ in range(300)} | {(1000, 1000 + i) for i in range(1, 150)} | {(i, i + 1) for i in range(2000, 2008)})
    ids = sorted({x for p in pairs for x in p})
    rank = {x: rng.randrange(20) for x in ids}
    near, taken, want = {}, set(), []
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for seed in sorted(ids, key=lambda x: (rank[x], x)):
        members = [seed, *(near[seed] - taken)]
        if seed not in taken and len(members) >= least:
            taken |= set(members)
            want += [(m, seed) for m in members]
    got = G.star_clusters(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(rank.items()), "id long, rank long"), least, finish)
    assert sorted(map(tuple, got.select("id", "cluster").collect())) == sorted(want)


def test_entities_of_the_query_bring_records_near(spark):
    make = spark.createDataFrame
    graph = R.EntityGraph(
        make([(1, "Redis"), (2, "cache"), (3, "to")], "id long, name string"), make([(1, 10), (2, 11), (3, 12), (4, 13)], "entity_id long, memory_id long"),
        make([(1, 2, 1), (4, 1, 2)], "source long, target long, strength long"),
    )
    asked = make([(7, "move to REDIS now"), (8, "nothing")], "query_id long, query string")
    links = make([(20, 21, 0.6, "related")], "source_id long, target_id long, strength double, link_type string")
    near = R.graph_proximity(make([(7, 20)], "query_id long, id long"), links, graph.named(asked), graph.bridge, graph.related)
    assert {(r.query_id, r.id, round(r.score, 6)) for r in near.collect()} == {(7, 10, 1.0), (7, 11, 0.5), (7, 13, 0.5), (7, 21, 0.6)}


def test_deep_search_keeps_queries_apart(spark):
    """Against the loop for one query after the other; results of a text come from a table."""
    rng = random.Random(4)
    texts = [f"t{i}" for i in range(30)]
    table = {t: [(rng.randrange(100), round(rng.random(), 3)) for _ in range(6)] for t in texts}
    table = {t: sorted({i: s for i, s in rows}.items(), key=lambda x: (-x[1], x[0])) for t, rows in table.items()}
    known = spark.createDataFrame([(t, i, s, r + 1) for t, rows in table.items() for r, (i, s) in enumerate(rows)], "query string, id long, score double, rank int")
    search = lambda q: q.join(known, "query").select("query_id", "id", "score", "rank")
    # The follow-up to a record is the text of its number; low numbers have none.
    more = lambda found, asked: R.top(found, 3).where("id >= 20").select("query_id", F.col("rank").alias("n"), F.concat(F.lit("t"), (F.col("id") % 30).cast("string")).alias("query"))

    def alone(query, iterations=3, most=12, each=4):
        found = dict(table[query][:each])
        asked = [query]
        for _ in range(iterations):
            if len(found) >= most:
                break
            ranked = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:3]
            follow = [(n + 1, f"t{i % 30}") for n, (i, _) in enumerate(ranked) if i >= 20 and f"t{i % 30}" not in asked]
            if not follow:
                break
            new = False
            for _, q in follow:
                room = min(each, most - len(found))
                if room <= 0:
                    break
                asked.append(q)
                for i, s in table[q][:room]:
                    new |= i not in found
                    found[i] = max(s, found.get(i, 0))
            if not new:
                break
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]

    asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:8])], "query_id long, query string")
    got = {}
    for r in R.deep_context(asked, search, more, most=12, each=4).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    assert got == {k: dict(alone(t)) for k, t in enumerate(texts[:8])}


def test_imports(spark, tmp_path):
    def read(kind, value, **more):
        folder = tmp_path / f"{kind}-{random.random()}"
        folder.mkdir()
        (folder / "f.md").write_text(value if isinstance(value, str) else json.dumps(value))
        return I.read_import(spark, str(folder), kind, **more).collect()

    node = lambda role, parts: {"message": {"author": {"role": role}, "content": {"parts": parts}}}
    talk = {"title": "A", "create_time": 1700000000.5, "mapping": {"b": node("user", [" fix this bug ", {"image": 1}, "now"]), "a": node("assistant", ["done"]), "s": node("system", ["no"]), "e": node("user", [""]), "n": {}}}
    (one,) = read("chatgpt", [talk, {"title": "empty", "mapping": {}}])
    assert one.content == "# A\n\n**User**: fix this bug \nnow\n\n**Assistant**: done" and one.tags == ["imported", "chatgpt", "debugging"]
    assert (one.importance, one.original_date, one.source) == (0.5, "2023-11-14T22:13:20.500Z", "chatgpt")
    said = [{"sender": "human", "text": "hi"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "human", "content": "plain"}, {"sender": "tool", "text": "x"}]
    (one,) = read("claude", {"name": "N", "updated_at": "2024", "chat_messages": said})
    assert one.content == "# N\n\n**User**: hi\n\n**Assistant**: a\nb\n\n**User**: plain" and one.original_date == "2024"
    assert [r.content for r in read("markdown", "intro\n## One\ntext\n\n---\nlast\n## Two\n")] == ["intro", "text", "last"]
    assert [r.content for r in read("chatexport", "a\nb\n\n\n c \n\n\n\n")] == ["a\nb", "c"]
    assert [(r.content, r.content_type, r.importance) for r in read("json", [{"content": "x", "importance": 0.25}, {"content": " "}, {"tags": []}])] == [("x", "text", 0.25)]
    backup = {"version": 1, "memories": [{"content": "m", "tier": "semantic"}], "entities": [], "memory_entities": [], "settings": {}}
    assert [(r.content, r.tier) for r in read("json", backup)] == [("m", "semantic")]
    assert [r.content for r in read("json", {"version": 1, "content": "no backup", "memories": []})] == ["no backup"]
    (one,) = read("obsidian", "---\ntags: [Alpha]\n---\nsee [[X|the x]]\n")
    assert one.content.strip() == "see the x" and {"imported", "obsidian", "alpha"} <= set(one.tags)
    with pytest.raises(ValueError):
        I.read_import(spark, str(tmp_path), "other")


def test_word_boundaries_are_ascii(spark):
    rows = spark.createDataFrame([("ßtest",), ("test",), ("a_test",), ("étest é",), ("x\\b",)], "s string")
    assert [r[0] for r in rows.select(F.col("s").rlike(ascii_bounds(r"\btest\b"))).collect()] == [True, True, False, True, False]
    assert ascii_bounds(r"\\b\d") == r"\\b\d"
