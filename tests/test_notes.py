"""Notes, session facts and tuning by hand values."""

from pyspark.sql import functions as F

from sparkloom.functions._clean import clean_lines, link_line
from sparkloom.operators import evaluate as E
from sparkloom.operators import knowledge as K
from sparkloom.operators import notes as N
from sparkloom.sources import ingest as I


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_cleaning_keeps_code_and_drops_furniture():
    long_ = "A line of more than twenty characters."
    assert clean_lines(f"# A\n\n\nCopy page\n{long_}\n{long_.upper()}\n## a\n```\nCopy page\n\n\n```\nNext", False) == f"# A\n\n{long_}\n```\nCopy page\n\n\n```"
    assert clean_lines("id: string\none\ntwo\nthree\nSome prose here, at last.\nGetting Started\n2 more\nname", True) == "one\nSome prose here, at last.\nname"
    assert clean_lines("", True) == ""


def test_prose_ratio(spark):
    assert one(spark, N.prose_ratio, "# Head\nshort\nname: string and so on for more than forty characters\nA sentence that is longer than forty characters is prose.") == 0.5
    assert one(spark, N.prose_ratio, "") == 0.0
    assert one(spark, N.low_quality, None) is True


def test_chunks_lose_what_the_chunk_before_ends_with(spark):
    tail = "the last words of the first one"
    rows = [("p", 1, "Start, " + tail), ("p", 2, tail + " and more"), ("p", 3, "more of it"), ("q", 1, tail)]
    got = N.without_overlap(spark.createDataFrame(rows, "k string, i int, content string"), "k", ["i"])
    assert sorted((r.k, r.i, r.content) for r in got.collect()) == [("p", 1, rows[0][2]), ("p", 2, " and more"), ("p", 3, "more of it"), ("q", 1, tail)]


def test_links_stay_out_of_head_code_and_headings(spark):
    pages = spark.createDataFrame([("Topics", "red-fox", "Red Fox"), ("Topics", "rust", "Rust"), ("Topics", "own", "Own page")], "section string, slug string, title string")
    body = "---\ntag: rust\n---\n# Rust\nThe red fox writes Rust, rust and [[Rust]].\n```\nrust\n```\n- [[rust]] stays\nown page\n\nrusty"
    notes = spark.createDataFrame([("own", body, 1), ("bare", "", 1)], "slug string, body string, extra int")
    got = {r.slug: r.body for r in N.linked(notes, pages).collect()}
    want = body.replace("The red fox writes Rust,", "The [[Topics/red-fox|Red Fox]] writes [[Topics/rust|Rust]],")
    assert got == {"own": want, "bare": ""}
    assert link_line("Rust", ["Rust Belt", "Rust"], ["a", "b"]) == "b"
    assert N.linked(notes.where("false"), pages).count() == 0
    assert N.linked(notes, pages.where("false")).where("slug = 'own'").first().body == body


def test_context_files_by_part(spark):
    rows = spark.createDataFrame(
        [("p", 2, "second", ["decision"], "episodic"), ("p", 1, "first", ["architecture"], "semantic"), ("p", 3, "x" * 501, ["learning", "style"], "episodic"), ("p", 4, "a fact", None, "semantic"), ("p", 5, "left out", [], "episodic"), ("q", 1, "no part", [], "working")],
        "name string, rank int, content string, tags array<string>, tier string",
    )
    got = {r.name: r.body for r in N.context_files(rows).collect()}
    assert got["p"] == "# p — Context\n\n## Architecture & Decisions\n- first\n- second\n\n## Techniques & Patterns\n- " + "x" * 500 + "...\n\n## Key Facts\n- a fact"
    assert got["q"] == "# q — Context"


def test_session_facts_with_neighbours_once(spark):
    text = "It was slow for a while. We found that the cache was stale. Then it was quick again."
    rows = [(1, 1, text), (1, 2, text.replace("slow", "very slow")), (1, 3, "Let me look. We decided to go."), (2, 1, "Nothing to tell here at all, really."), (2, 2, None)]
    got = I.session_facts(spark.createDataFrame(rows, "session_id int, line int, text string")).collect()
    assert [(r.session_id, r.place, r.kind, r.fact) for r in got] == [(1, 0, "discovery", text)]


def test_auto_expansion(spark):
    assert one(spark, K.auto_expansion, "Search the wiki") == "retrieval query find article documentation knowledge search-the the-wiki"
    assert one(spark, K.auto_expansion, "goal objective") == "milestone target goal-objective"
    assert one(spark, K.auto_expansion, "hm") is None and one(spark, K.auto_expansion, None) is None


def test_tuning_finds_the_signal_that_matters(spark):
    rows = [(q, i, float(i == q % 4), float(i) / 4) for q in range(40) for i in range(4)]
    signals = spark.createDataFrame(rows, "query_id int, id int, good double, bad double")
    judged = signals.where("good = 1").select("query_id", "id", F.lit(1).alias("grade"))
    weights, tuned, held_out = E.tune(signals, judged, {"good": 0.3, "bad": 0.9}, steps=(0.25, 4.0))
    assert weights["good"] > weights["bad"] and tuned == 1.0 and held_out == 1.0


def test_hypothetical_asks_once_for_each_text(spark):
    queries = spark.createDataFrame([(1, "A b"), (2, " a B "), (3, None)], "query_id int, query string")
    made, cache = K.hypothetical(queries, lambda q: "said")
    assert sorted((r.query_id, r.query) for r in made.collect()) == [(1, "A b said"), (2, " a B  said"), (3, None)]
    assert cache.count() == 1


def test_promote_and_reset(spark):
    base = spark.createDataFrame([("a", [1]), ("b", [2])], "query string, ids array<int>")
    runs = spark.createDataFrame([("r", "b", [3]), ("r", "c", [4]), ("s", "a", [9])], "run_id string, query string, ids array<int>")
    assert sorted((r.query, r.ids) for r in E.promote(base, runs, "r").collect()) == [("a", [1]), ("b", [3]), ("c", [4])]
    assert [r.query for r in E.reset(base, ["a"]).collect()] == ["b"] and E.reset(base).count() == 0
