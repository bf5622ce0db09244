"""The whole pipeline, each stage against a brute-force version on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from test_corpus import brute_classes, fill
from test_rows import brute_quality

from sparkloom.llm import pii, quality

SMALL = "/root/testdata/sf0.001"


def words13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(text, items):
    w = words13(text)
    hit = set()
    for item in items:
        n = min(13, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        hit |= {j for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in windows for j in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    prose = docs.where("length(text) > 400").orderBy("doc_id").first().text
    more = [
        (None, f"{prose} Write to one@example.org soon.", "en", "src0", 1), (None, item + " " + item, "en", None, 1), (900_001, prose, "en", "src1", 1), (900_001, prose + " tail", "en", "src1", 1),
        (900_002, None, "en", "src1", 0), (900_003, "", "en", "src1", 0), (900_004, "short", None, "src1", 5),
    ]
    docs.unionAll(spark.createDataFrame(more, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    at, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, folder).write.parquet(f"{folder}/stage-{name}")
        new = spark.read.parquet(f"{folder}/stage-{name}")
        out.append((at, new))
        at = new
    return folder, docs.columns, out


def rows(df):
    return sorted(map(str, df.collect()))


def test_quality_stage(spark, stages):
    folder, columns, ((before, after), *_) = stages
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ratio, least = quality.train(before.select("doc_id", "text"), labels)
    import numpy as np

    keep = []
    for r in before.collect():
        data = (r.text or "").encode()
        grams = [int.from_bytes(data[i : i + 4], "big") for i in range(len(data) - 3)]
        score = np.mean([ratio[((g * 2654435761) & 0xFFFFFFFF) >> 17] for g in grams]) if grams else 0.0
        assert abs(score - least) > 1e-9
        if not brute_quality(r.text)[5] and score >= least:
            keep.append(str(r))
    assert sorted(keep) == rows(after) and after.columns == columns


def test_near_duplicate_stage(stages):
    _, columns, (_, (before, after), *_) = stages
    given = before.collect()
    # Rows are numbered by id, so that equal and missing ids stay apart.
    given.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    classes = dict(brute_classes([(i, r.text) for i, r in enumerate(given)]))
    kept = after.collect()
    assert len(kept) == len(set(classes.values())) and after.columns == columns
    found = {classes[i] for i, r in enumerate(given) if r in kept}
    assert found == set(classes.values())


def test_decontamination_stage(spark, stages):
    folder, columns, (_, _, (before, after), *_) = stages
    items = [words13(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(str(r) for r in before.collect() if not contaminated(r.text, items)) == rows(after) and after.columns == columns
    assert before.count() > after.count()


def test_personal_data_stage(stages):
    _, columns, (*_, (before, after), _) = stages
    want = []
    for r in pii.find_pii(before, columns=tuple(columns)).collect():
        out, at = [], 0
        for s in sorted(r.spans, key=lambda s: (s.start, -s.stop)):
            if s.start >= at:
                out += [r.text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.stop)
        text = "".join(out) + r.text[at:]
        want.append((r.doc_id, text, len(text)))
    key = lambda x: (x[0] is None, x)
    assert sorted(want, key=key) == sorted(((r.doc_id, r.text, r.n_chars) for r in after.collect()), key=key) and after.columns == columns
    assert any("[EMAIL]" in w[1] for w in want)


def test_mixing_stage(stages):
    *_, (before, after) = stages[2]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before.collect():
        total[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, fill([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for r in after.collect():
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order)


def test_tables_without_lengths(spark, stages, tmp_path):
    folder, columns, ((before, _), *_) = stages
    got = corpus_pipeline.without_pii(spark, before.drop("n_chars"), folder)
    assert got.columns == [c for c in columns if c != "n_chars"]


def test_the_run_is_all_stages(spark, stages):
    folder, _, out = stages
    assert rows(corpus_pipeline.run(spark, folder)) == rows(out[-1][1])
