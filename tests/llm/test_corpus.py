"""Corpus-wide operators against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import decontam, mixing, order_minhash, suffix_array

SMALL = "/root/testdata/sf0.001"
HARD = [(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (None, "x " * 60), (5, "x " * 60), (5, "x " * 60), (6, "é" * 40), (7, "ü" + "é" * 40), (8, "!!!"), (9, "!!!"), (10, "Z" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    hard = spark.createDataFrame([(a + 100_000 if a else a, b) for a, b in HARD], "doc_id long, text string")
    return hard.unionAll(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))


def brute_repeats(rows, length=50):
    least = {}
    data = [((r[0] if r[0] is not None else -(1 << 63)), (r[1] or "").encode()) for r in rows]
    for i, t in data:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if least.get(w, i) >= i:
                least[w] = i
    out = []
    for (i, t), r in zip(data, rows):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((str(r[0]), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("buckets", [None, 3])
def test_repeats(docs, buckets):
    got = suffix_array.remove_repeats(docs.withColumn("g", docs.text), buckets=buckets).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(docs.collect())
    assert suffix_array.remove_repeats(docs.where("false")).count() == 0


def test_window_minima():
    rng = np.random.default_rng(1)
    for n, k in ((30, 2), (400, 3), (3000, 2)):
        text = rng.integers(0, k + 1, n).astype(np.uint16)
        text[-1] = 0
        length = 6
        value = np.full(n, suffix_array.NONE)
        best = {}
        for p in range(n - length + 1):
            w = tuple(text[p : p + length])
            if 0 not in w:
                value[p] = rng.integers(0, 100)
                best[w] = min(best.get(w, suffix_array.NONE), value[p])
        out = suffix_array.window_minima(text, value, length)
        assert all(out[p] == best[tuple(text[p : p + length])] for p in range(n) if value[p] != suffix_array.NONE)


def shingles(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or ""))
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    seen, out = defaultdict(int), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def similar(a, b):
    """Aligned shingles by the longest common subsequence of labelled shingles."""
    at = {g: j for j, g in enumerate(b)}
    places = [at[g] for g in a if g in at]
    ends = []
    from bisect import bisect_left

    for x in places:
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends) >= 0.8 * (len(a) + len(b) - len(ends)) and len(ends) > 0


def brute_classes(rows):
    ids = [r[0] if r[0] is not None else -(1 << 63) for r in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sh = [shingles(r[1]) for r in rows]
    sets = [set(s) for s in sh]
    for i in range(len(rows)):
        for j in range(i):
            same = similar(sh[i], sh[j]) if sh[i] and sh[j] and len(sets[i] & sets[j]) * 1.8 >= 0.8 * (len(sh[i]) + len(sh[j])) - 1e-6 else False
            if same or (rows[i][1] and rows[i][1] == rows[j][1]):
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return sorted((ids[i], find(ids[i])) for i in range(len(rows)))


def test_near_duplicates(spark, docs):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(220)) for _ in range(6)]
    more = []
    for b, text in enumerate(base):
        words = text.split()
        for c in range(40):  # a chain: each copy changes one more word
            words[rng.randrange(220)] = f"n{c}"
            more.append((10_000 + 100 * b + c, " ".join(words)))
    common = " ".join(f"c{i}" for i in range(60))
    more += [(20_000 + i, common + " " + " ".join(f"u{i}x{k}" for k in range(60))) for i in range(60)]
    table = docs.unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    got = order_minhash.near_duplicates(table.withColumn("class_id", table.doc_id)).collect()
    least = lambda x: x if x is not None else -(1 << 63)
    want = brute_classes(table.collect())
    assert sorted((least(r.doc_id), least(r.class_id)) for r in got) == want
    kept = order_minhash.drop_near_duplicates(table)
    assert kept.count() == len({c for _, c in want})
    assert order_minhash.near_duplicates(table.where("false")).count() == 0


@pytest.mark.parametrize("one_task", [0, 250_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(order_minhash, "EDGES_A_TASK", max(1, one_task))
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    got = {r.node: r.label for r in order_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
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


def test_decontamination_of_hard_rows(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:20])), (2, "Short, item!"), (3, None), (4, ""), (5, " ".join(words[10:30])), (None, "lone")]
    rows = [(1, " ".join(words)), (2, "a short ITEM b short"), (3, None), (4, ""), (5, " ".join(words[1:13])), (6, " ".join(words[7:20] + ["x"] * 300)), (6, "lone"), (6, "lone"), (None, "x lone")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", __import__("pyspark").sql.functions.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.decontaminate(d, b).collect())
    assert got == [(-1, 2, 1, 0, True), (1, 40, 30, 2, True), (2, 5, 2, 1, True), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 12, 0, 0, False), (6, 1, 1, 0, True), (6, 1, 1, 0, True), (6, 313, 13, 1, False)]
    shuffled = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.decontaminate(d, b, broadcast_rows=0).collect())
    assert shuffled == got
    assert not any(r.n_hit for r in decontam.decontaminate(d, b.where("false")).collect())
    assert decontam.decontaminate(d.where("false"), b).count() == 0


def test_kept_hashes_guarantee_every_shared_window(spark):
    """Brute-force winnowing, and a kept hash inside every window of each length."""
    rng = random.Random(9)
    rows = [(i, [f"w{rng.randrange(4)}" for _ in range(n)]) for i, n in enumerate((0, 1, 4, 5, 12, 13, 14, 60, 200))]
    table = spark.createDataFrame(rows, "id long, words array<string>")
    got = defaultdict(set)
    hashes = {}
    for r in decontam.fingerprints(table, [1, 3, 7, 13]).collect():
        got[r.id, r.len].add(r.at)
    for r in decontam.fingerprints(table, [5]).collect():
        hashes[r.id, r.at] = r.fp
    for i, words in rows:
        for n in (1, 3, 7, 13):
            k = min(5, n)
            w = n - k + 1
            runs = len(words) - k + 1
            if k == 5:
                g = [hashes[i, at] for at in range(1, runs + 1)]
                want = {p + 1 for s in range(runs - w + 1) for p in range(s, s + w) if g[p] == min(g[s : s + w])}
                assert got[i, n] == want
            assert all(got[i, n] & set(range(s, s + w)) for s in range(1, runs - w + 2))


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "CASE WHEN doc_id % 50 = 0 THEN null ELSE source END AS source")
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.03 * t, s
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-6 * sum(target.values())
    odd = spark.createDataFrame([(None, None, None), (1, "", "a"), (2, "x y", None), (2, "x y", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken) for r in mixing.mix_sources(odd).collect()} == {(None, 0), (1, 0), (2, 2)}
    assert mixing.mix_sources(odd.where("false")).count() == 0


def fill(sizes, weights, cap=3):
    """Reference water filling by repeated sharing."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / weight > cap * sizes[i]]
        if not above:
            return [fixed.get(i, left * weights[i] / weight) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in above}


def test_water_filling(spark):
    for sizes in ([10, 10, 80], [0, 5], [1, 2, 3, 400, 5, 6], [7], [1000, 1, 1, 1, 1]):
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        rows = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "sid long, size long, weight double")
        got = {r.sid: r.target for r in mixing.water_fill(rows).collect()}
        assert [got[i] for i in range(len(sizes))] == pytest.approx(fill(sizes, weights))


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing_sizes_and_targets(spark, monkeypatch, broadcast):
    import re

    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rng = random.Random(4)
    names = ["b", "a", None, "Z", "é", "𝄞", "\uffff", "", "zz"]
    rows = [(i, rng.choice([" a\tb\n", "x " * rng.randrange(300), "", None, "\x0bé\x1cq r "]), names[min(int(rng.expovariate(0.6)), 8)]) for i in range(400)] + [(7, "one id again", "a")] * 150
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "text AS sid", "source AS k", "1 AS size", "2 AS cls")
    got = mixing.mix_sources(table).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, fill([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    assert sorted((r.doc_id, r.source or "-", r.size) for r in got) == sorted((i, s or "-", size(t)) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(310, 0.02 * target[s]), s


@pytest.mark.parametrize("split", [0, 400])
def test_close_pairs_of_a_block(split):
    rng = np.random.default_rng(0)
    n = 700
    side = (np.arange(n) >= split).astype(int) if split else np.zeros(n, int)
    label, size = rng.integers(0, 5, n), rng.integers(90, 110, n)
    parity = rng.integers(0, 2**63, (20, order_minhash.PARITY_WORDS)).astype(np.uint64)[rng.integers(0, 20, n)]
    for _ in range(6):
        parity[np.arange(n), rng.integers(0, order_minhash.PARITY_WORDS, n)] ^= np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if split else (np.arange(n), np.arange(n))
    apart = {(a, b): int(np.bitwise_count(parity[a] ^ parity[b]).sum()) for a in left.tolist() for b in right.tolist() if (a < b or split) and label[a] != label[b]}
    want = {p: d for p, d in apart.items() if d <= (size[p[0]] + size[p[1]]) * 0.2 / 1.8 + 1e-6}
    assert len(want) > 3000
    for most in (3, 10**6):
        i, j, cut = order_minhash._close_pairs(side, label, size, parity, most)
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        assert got <= set(want) and cut == (len(got) < len(want)) and (most == 3 or not cut)
        for end in (0, 1):  # the closest pair of each row is there
            nearest = {}
            for p, d in want.items():
                nearest[p[end]] = min(d, nearest.get(p[end], d))
            assert all(min(want[p] for p in got if p[end] == k) == d for k, d in nearest.items())
