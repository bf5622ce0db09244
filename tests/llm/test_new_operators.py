"""Ranked search, archives and whitening against brute force, on hard rows and on small tables."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import block_max, warc, whitening
from sparkloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tuples(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("name", ["op11_block_max", "op12_archives"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert tuples(got, *want.columns) == sorted(want.fetchall(), key=str)


def brute_search(docs, items, top=10):
    tf = [(d, [w for w in TERM.findall((t or "").translate(LOWER))]) for d, t in docs]
    held = [(d, w) for d, w in tf if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, words in held:
            m, score = 25 + (75 * len(words) * n) // total, 0
            for w in TERM.findall((text or "").translate(LOWER)):
                if w in df:
                    k = words.count(w)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * k) // (1000 * k + 8 * m))
            if score > 0:
                scores.append((-score, d is not None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


HARD = [
    (None, "null id alpha beta"), (None, None), (1, ""), (2, " \n"), (3, "Alpha ALPHA alpha é"), (4, "É é straße Straße STRASSE"), (5, "alpha"), (6, "alpha"), (6, "alpha"), (7, "a" * 3000 + " beta"),
    (8, "beta " * 70_000), (9, "x y alpha_beta alpha-beta 0 0"), (10, "𝄞𝄞 gamma"), (11, "delta"), (-5, "alpha"),
]
ITEMS = [(1, "alpha beta"), (1, "alpha beta"), (None, "GAMMA 𝄞𝄞"), (2, None), (3, ""), (4, "nowhere"), (5, "alpha alpha é straße 0"), (6, "beta"), (7, "alpha " * 500)]


def test_search_on_hard_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "x") for r in HARD], "doc_id long, text string, term string").withColumn("segment", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = block_max.ranked_search(docs.repartition(3), items)
    assert tuples(got, "item_id", "rank", "doc_id", "score") == brute_search(HARD, ITEMS)
    monkeypatch.setattr(block_max, "QUERIES", 2)
    assert tuples(block_max.ranked_search(docs, items), "item_id", "rank", "doc_id", "score") == brute_search(HARD, ITEMS)
    assert block_max.ranked_search(docs.limit(0), items).count() == 0
    assert block_max.ranked_search(docs, items.limit(0)).count() == 0


def test_search_skips_blocks(spark, monkeypatch):
    """Many blocks of which few can reach the threshold; ties over segments; results equal those of brute force."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words[:50], k=30))) for i in range(3000)] + [(3000 + i, " ".join(["rare", "w1", "w2"] + ["pad"] * (i % 7))) for i in range(40)]
    items = [(i, " ".join(rng.sample(words, 6))) for i in range(8)] + [(99, "rare w1 w2"), (100, "rare")]
    opened = []
    inner = block_max._List.postings
    monkeypatch.setattr(block_max._List, "postings", lambda self, blocks: (opened.append(len(blocks)), inner(self, blocks))[1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert tuples(block_max.ranked_search(df, spark.createDataFrame(items, "item_id long, text string")), "item_id", "rank", "doc_id", "score") == brute_search(docs, items)
    # The same kernel here, where its decompressions can be counted.
    folder = spark.conf.get("spark.checkpoint.dir") + "/skips"
    block_max.build_index(df.coalesce(1), folder)
    rows = spark.read.parquet(f"{folder}/lists").where("term IN ('', 'rare', 'w1', 'w2')").collect()
    top = next(r for r in rows if r["term"] == "")
    m = np.frombuffer(top["body"], "<i8")
    lists = {r["term"]: block_max._List(r["heads"], r["body"], m) for r in rows if r["term"] and r["segment"] == top["segment"]}
    ranking = block_max.Ranking(10)
    block_max.search_segment(lists, np.frombuffer(top["heads"], "<i8"), [("rare", 4000), ("w1", 600), ("w2", 600)], ranking)
    assert not lists["w1"].open.all() and len(ranking.scores) == 10
    assert sum(lists["w1"].open) < len(lists["w1"].open) / 2


def page_rows():
    big = "<p>" + "x" * 3_000_000
    return [
        (1, "http://a/1", "same"), (2, "http://a/2", "same"), (0, "http://a/0 b\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (None, "n", "same"), (None, "n", "same"), (None, None, "only null"),
        (7, "twice", "seven"), (7, "twice", "seven"), (7, "other", "seven"), (8, "é", "ü𝄞\x00\r\n\r\nWARC/1.1\r\n"), (9, "v", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"),
    ]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute_records(rows, least=0):
    out, seen = [], set()
    for pid, url, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        size = len((html or "").encode())
        first = min(same) if same and size >= least else None
        if first is None or (pid == first and (html or "") not in seen):
            seen.add(html or "") if pid is not None else None
            out.append((pid, size, digest(html), "response", None))
        else:
            out.append((pid, size, digest(html), "revisit", first))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_on_hard_rows(spark, tmp_path, least):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, kind int")
    folder = f"{tmp_path}/out"
    manifest = warc.write_archives(pages.repartition(4), folder, roll_bytes=500, least_revisit=least, shards=3)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 3
    back = warc.read_archives(spark, folder)
    assert tuples(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute_records(rows, least)
    assert len({r.record_id for r in back.collect()}) == len(rows)
    held = {(r.page_id, bytes(r.payload)) for r in back.where("record_type = 'response'").collect()}
    assert held <= {(p, (h or "").encode()) for p, _, h in rows}
    with pytest.raises(FileExistsError):
        warc.write_archives(pages, folder)


def test_archives_do_not_depend_on_partitions(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    every = pages.unionAll(pages.withColumn("page_id", F.col("page_id") + 1000))
    found = []
    for n in (2, 5):
        warc.write_archives(every.repartition(n), f"{tmp_path}/{n}", roll_bytes=20_000, shards=4)
        found.append({f.name: f.read_bytes() for f in (tmp_path / str(n)).glob("part-*")})
    assert found[0] == found[1] and len(found[0]) > 4
    assert not (tmp_path / "2/_temporary").exists()
    name, data = next(iter(found[0].items()))
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and name.encode() in gzip.decompress(data)
    (tmp_path / "5" / name).write_bytes(data[:-40])
    with pytest.raises(Exception):
        warc.read_archives(spark, f"{tmp_path}/5").count()


def test_small_shards_share_tasks(spark, tmp_path):
    """Many small shards are written, renamed and read by few tasks; the files stay one sequence for each shard."""
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html"))
    manifest = warc.write_archives(pages, f"{tmp_path}/out", shards=40)
    assert manifest.count() == 40 and manifest.where("part = 0 AND file = concat('part-', lpad(shard, 6, '0'), '-00000.warc.gz')").count() == 40
    assert len(list((tmp_path / "out/_manifest").glob("part-*.parquet"))) == 1
    back = warc.read_archives(spark, f"{tmp_path}/out")
    assert back.rdd.getNumPartitions() == 1
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in back.collect()) == [(i, str(i) * 50) for i in range(2000)]


@pytest.mark.parametrize("harm", [lambda d: d[:-1], lambda d: d + b"\x1f", lambda d: d[:40] + bytes([d[40] ^ 1]) + d[41:], lambda d: d + gzip.compress(b"WARC/1.1\r\n")])
def test_damaged_members_are_found(harm):
    whole = warc.response(1, "u", "k", b"text" * 50, digest("text" * 50)) + warc.revisit(2, None, "l", 200, digest("text" * 50), 1, "k")
    read = lambda data: [warc.record(m) for m in warc.members(io.BytesIO(data))]
    assert [f["WARC-Type"] for f, _ in read(whole)] == ["response", "revisit"]
    with pytest.raises((ValueError, zlib.error)):
        read(harm(whole))


def test_archives_of_nothing(spark):
    assert warc.archive_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_whitening(vectors, k=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(axis=0)
    apart = (n * u - total) / n
    values, turns = np.linalg.eigh(apart.T @ apart / n)
    values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
    own = n * x - total
    return n, (own**2).sum(axis=1), values, (own / n) @ turns / np.sqrt(values), values / np.trace(apart.T @ apart / n)


def test_whitening_against_numpy(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    got = QUERIES["op13_whitening"](spark, SMALL).toPandas()
    n, deviation, values, white, shares = brute_whitening([r.embedding for r in rows])
    mine = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    mine = mine * np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white).max() < 1e-9
    first = got[got.component == 1].sort_values("vec_id")
    assert (first.deviation.to_numpy() == deviation).all() and (got.n == n).all()
    assert np.abs(got[got.vec_id == 0].sort_values("component").explained.to_numpy() - shares).max() < 1e-12
    assert got.identity_error.max() < 1e-9


def test_whitening_on_hard_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 5)).round(3).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(i, v) for i, v in enumerate(good)] + [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [nan] * 5), (53, [inf, 0.0, 0.0, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (None, good[0]), (0, good[0]), (0, good[1])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, n int, y double")
    got = whitening.whiten(df).toPandas()
    n, deviation, values, white, shares = brute_whitening(good)
    assert sorted(got.component.unique()) == [1, 2, 3, 4, 5] and len(got) == 5 * 43 and (got.n == n).all()
    assert abs(got[got.component == 1].explained.iloc[0] - shares[0]) < 1e-12 and got.identity_error.max() < 1e-12
    assert got.vec_id.isna().sum() == 5
    none = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none.limit(0)).count() == 0
    assert whitening.whiten(none).columns == [f.split()[0] for f in whitening.WHITENED.split(", ")]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None, 4096}


def test_lanczos_restarts_and_breaks_down():
    """A large space with few steps of the basis; equal eigenvalues; an operator of low rank."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(300, 300)))
    for spectrum in (np.geomspace(1, 1e-6, 300), np.r_[np.ones(20), np.full(280, 1e-3)], np.r_[[5.0, 3.0, 3.0], np.zeros(297)]):
        a = (q * spectrum) @ q.T
        values, vectors = whitening.block_lanczos(lambda v, a=a: a @ v, 300, 8, block=4, most=40)
        assert np.abs(values - spectrum[:8]).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-11
        assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-10
