"""Cases in which a cut of the work would lose rows or links."""

import random
import time

from sparkloom.llm import decontam, order_minhash, secrets


def test_star_whose_centre_has_the_greatest_id(spark):
    rng = random.Random(7)
    centre = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(10**6, " ".join(centre))]
    for c in range(2000):  # 176 of 216 runs of five words are shared with the centre
        words = list(centre)
        for p in rng.sample(range(200), 4):
            words[p] = f"n{c}x{p}"
        rows.append((c, " ".join(words)))
    rows += [(20_000 + i, " ".join(centre[:120] + [f"u{i}x{k}" for k in range(120)])) for i in range(50)]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len({r.class_id for r in got if r.doc_id < 2000 or r.doc_id == 10**6}) == 1
    assert all(r.n_members == 1 for r in got if 20_000 <= r.doc_id < 20_050)


def test_documents_without_or_with_repeated_ids_stay(spark):
    text = lambda i: " ".join(f"t{i}x{k}" for k in range(40))
    rows = [(None, text(i)) for i in range(5)] + [(1, text(5)), (1, text(6)), (None, text(0)), (1, text(5)), (2, text(6)), (3, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = order_minhash.drop_near_duplicates(docs)
    assert sorted(r.text for r in kept.collect()) == sorted(text(i) for i in range(8))
    groups = order_minhash.near_duplicates(docs).collect()
    assert sum(r.representative for r in groups) == 8
    assert sorted(r.n_members for r in groups) == [1] * 5 + [2] * 6
    items = spark.createDataFrame([(1, text(0)), (2, text(5))], "item_id long, text string")
    clean = decontam.drop_contaminated(docs, items)
    assert sorted(r.text for r in clean.collect()) == sorted(t for _, t in rows if t not in (text(0), text(5)))


def test_different_texts_with_equal_polynomials_stay_apart(spark):
    """Word sequences in Thue-Morse order, and words that are such strings, meet in sums of powers modulo 2 ** 64."""
    turn = str.maketrans("ab", "ba")
    a = "a"
    for _ in range(11):
        a += a.translate(turn)
    b = a.translate(turn)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, f"{a} one two three four five six"), (4, f"{b} one two three four five six"), (5, " ".join(a)), (6, "!" + a[:1024].replace("a", "?").replace("b", "!")), (7, "!" + b[:1024].replace("a", "?").replace("b", "!"))]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[3], got[4], got[6], got[7]) == (3, 4, 6, 7) and got[1] == got[5] and got[2] != got[1]


def test_columns_may_have_any_name(spark):
    names = ("_rn", "_t", "_kept", "_kept_t", "_bad", "_bad_h", "row", "kept", "id", "t", "rn", "own", "bad", "node", "rep")
    text = lambda i: " ".join(f"t{i}x{k}" for k in range(40))
    docs = spark.createDataFrame([(i, text(i % 3), *["v"] * len(names)) for i in range(5)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = order_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    clean = decontam.drop_contaminated(docs, spark.createDataFrame([(1, text(1))], "item_id long, text string"))
    assert clean.columns == docs.columns and clean.count() == 3


def test_work_is_linear_in_one_text(spark):
    """A megabyte of letters before a sign, as base64 has it, and a document of 100,000 hits end in seconds."""
    began = time.time()
    rows = [(1, "A" * 1_000_000 + "=" + " plain_words here"), (2, "QUJD" * 250_000 + "=="), (3, "ordinary_name other_name12 x")]
    assert secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3
    words = [f"w{i}" for i in range(20_000)]
    items = [(k, " ".join(words[k * 1000 : (k + 1) * 1000])) for k in range(20)]
    docs = [(1, " ".join(words * 5)), (2, " ".join(words[:500]) + " " + "x " * 50), (3, "y " * 10)]
    got = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (100_000, 100_000, 20)
    assert (got[2].n_hit, got[2].n_items, got[3].n_hit) == (500, 1, 0)
    assert time.time() - began < 120
