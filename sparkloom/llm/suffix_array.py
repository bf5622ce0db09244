"""Removal of repeated byte strings by threshold-bounded interval expansion.

Texts are cut into segments by minimisers: every window of LENGTH bytes belongs
to the least GRAM-byte run inside it, and consecutive windows of the same run
form one segment. Equal windows have equal runs, so that only segments with the
same run (anchor) can share a window, and anchors are dealt over buckets.

An anchor whose segments are all equal is settled by their digest. Where the
segments differ, a bucket builds the Burrows-Wheeler transform of their bytes
and extends intervals backwards, breadth first: level by level this marks the
borders of suffixes whose common prefix has that length, and it stops at
LENGTH. What is left unmarked joins equal windows, whose least document follows.

Texts are packed into groups of about a block, written once. A group sends each
of its distinct segments once, whatever its number of copies, so that a passage
of many documents gives one record for each group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _kernel as K
from sparkloom.llm._base import keep, shared_dir
from sparkloom.shipping import ship

LENGTH = 50
#: Long enough that equal runs hardly ever meet by chance, also in text of few different syllables.
GRAM = 20
SPAN = LENGTH - GRAM + 1
#: Symbols of segments that one transform is built over (an anchor with more is a transform of its own).
SLICE = 1 << 20
NONE, OPEN = np.int64(1 << 62), np.int64((1 << 62) + 1)
_LEAST_ID = -(1 << 63)
_SEGMENT = np.dtype([("anchor", "<u4"), ("low", "<u4"), ("high", "<u2"), ("doc", "<i8")])


class Segments:
    """Segments of a group: text, start and end of each, and each one's distinct number in bucket order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, buckets: int) -> None:
        self.data, self.offsets, self.ids = data, offsets, ids
        n = len(data)
        self.start = self.end = self.text = self.distinct = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.anchor, self.digest, self.bounds = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(buckets + 1, np.int64)
        if n < LENGTH:
            return
        prefix = K.prefix_hash(data)
        at = np.arange(n - GRAM + 1)
        gram = K.segment_hash(prefix, at, at + GRAM)
        least = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SPAN - width
        if rest:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        shift = np.zeros(n + 1, np.int32)
        ends = offsets[1:]
        np.add.at(shift, np.maximum(offsets[:-1], ends - LENGTH + 1), 1)
        np.add.at(shift, ends, -1)
        valid = (np.cumsum(shift) == 0)[: len(place)]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
        self.start, self.end = np.flatnonzero(fresh), np.flatnonzero(last) + LENGTH
        if not len(self.start):
            return
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        anchor = gram[place[self.start]]
        _, first, inverse = np.unique(K.segment_hash(prefix, self.start, self.end), return_index=True, return_inverse=True)
        bucket = ((anchor[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.first, self.distinct = first[order], rank[inverse]
        self.bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.anchor = anchor[self.first]
        self.digest = K.segment_hash(prefix, self.start[self.first], self.end[self.first])

    @property
    def least(self) -> np.ndarray:
        """The least document of each distinct segment in this group: texts are in order of their id."""
        return self.ids[self.text[self.first]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for rows, data, offsets in K.small_batches(batches, "text"):
        ids = np.asarray(rows.column("doc_id"))
        order = np.argsort(ids, kind="stable")
        sizes = np.diff(offsets)[order]
        blob = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in order)
        packed = zstandard.compress(blob, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | number]), pa.array([ids[order].tolist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
            ["g", "ids", "sizes", "blob"],
        )
        number += 1


def _group(table: pa.Table | pa.RecordBatch, row: int, buckets: int) -> Segments:
    ids = np.asarray(table.column("ids")[row].values)
    sizes = np.asarray(table.column("sizes")[row].values)
    data = np.frombuffer(zstandard.decompress(table.column("blob")[row].as_py()), np.uint8)
    return Segments(data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), ids, buckets)


def _records(buckets: int):
    """One row for each group and bucket: anchor, digest and least document of the distinct segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = _group(batch, row, buckets)
                full = np.flatnonzero(np.diff(s.bounds))
                if not len(full):
                    continue
                out = np.empty(len(s.first), _SEGMENT)
                out["anchor"], out["low"] = s.anchor.astype(np.uint32), s.digest.astype(np.uint32)
                out["high"], out["doc"] = (s.digest >> np.uint64(48)).astype(np.uint16), s.least
                blobs = [out[s.bounds[b] : s.bounds[b + 1]].tobytes() for b in full]
                g = batch.column("g")[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([g] * len(full)), pa.array(blobs, pa.binary())], ["bucket", "g", "blob"])

    return run


def _settle(table: pa.Table) -> pa.Table:
    """For a bucket: the least document of anchors with one segment, and which anchors need the transform."""
    blobs = [np.frombuffer(x, _SEGMENT) for x in table.column("blob").to_pylist()]
    rows = np.concatenate(blobs) if blobs else np.empty(0, _SEGMENT)
    group = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
    digest = rows["low"].astype(np.uint64) | rows["high"].astype(np.uint64) << np.uint64(32)
    order = np.lexsort((digest, rows["anchor"]))
    a, d = rows["anchor"][order], digest[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.append(start, len(a)))
    changes = np.concatenate([[0], np.cumsum(np.concatenate([[False], d[1:] != d[:-1]]))])
    several = changes[start + size] - changes[start + 1] > 0
    least = np.minimum.reduceat(rows["doc"][order], start)
    verdict = np.repeat(np.where(several, OPEN, least), size)
    mine = np.repeat(size > 1, size)
    result = np.full(len(rows), NONE)
    result[order[mine]] = verdict[mine]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    out: list[tuple] = []
    bucket, gs = table.column("bucket").to_pylist(), table.column("g").to_pylist()
    for i in range(len(blobs)):
        own = result[at[i] : at[i + 1]]
        index = np.flatnonzero(own != NONE)
        if len(index):
            out.append((gs[i], bucket[i], index.astype(np.uint32).tobytes(), own[index].tobytes()))
    del group
    columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    return pa.table({"g": pa.array(columns[0], pa.int64()), "bucket": pa.array(columns[1], pa.int32()), "index": pa.array(columns[2], pa.binary()), "value": pa.array(columns[3], pa.binary())})


def _verdicts(table: pa.Table, s: Segments) -> np.ndarray:
    """The verdict on each distinct segment of a group."""
    out = np.full(len(s.first), NONE)
    for bucket, index, value in zip(*(table.column(c).to_pylist() for c in ("bucket", "index", "value")), strict=True):
        out[s.bounds[bucket] + np.frombuffer(index, np.uint32)] = np.frombuffer(value, np.int64)
    return out


def _open_segments(buckets: int):
    """The bytes of a group's segments that need the transform, for each bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in range(left.num_rows):
            s = _group(left, row, buckets)
            index = np.flatnonzero(_verdicts(right, s) == OPEN)
            bucket = np.searchsorted(s.bounds, index, "right") - 1
            for b in np.unique(bucket):
                own = index[bucket == b]
                first = s.first[own]
                a, e = s.start[first], s.end[first]
                body = b"".join(s.data[x:y].tobytes() for x, y in zip(a, e, strict=True))
                meta = np.concatenate([(e - a).astype(np.int64), s.anchor[own].view(np.int64), s.least[own]])
                out.append((int(b), left.column("g")[row].as_py(), zstandard.compress(meta.tobytes(), 1), zstandard.compress(body, 1)))
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "g": pa.array(columns[1], pa.int64()), "meta": pa.array(columns[2], pa.binary()), "body": pa.array(columns[3], pa.binary())})

    return run


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return order, rank


def window_minima(text: np.ndarray, value: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of ``text`` the least ``value`` among places where the same ``length`` symbols start.

    ``text`` has symbols from 1 and separators 0; ``value`` is NONE where no
    such string starts. Suffixes are sorted by at least ``length`` symbols,
    which is as much as the backward extension reads.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.int64)
    key, reach = np.zeros(n, np.int64), 7
    for j in range(reach):
        key = key << 9 | padded[j : j + n]
    order, rank = _ranks(key)
    while reach <= length:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - reach)] = rank[reach:] + 1
        order, rank = _ranks(rank * (n + 1) + ahead)
        reach *= 2
    transform = text[order - 1]
    back = np.argsort(transform, kind="stable")
    jump = np.empty(n, np.int64)
    jump[back] = np.arange(n)
    head = transform[back]
    turn = np.ones(n, bool)
    turn[1:] = head[1:] != head[:-1]
    # Level 0: one interval for each symbol.
    lower = np.flatnonzero(turn)
    upper = np.append(lower[1:], n)
    border = np.zeros(n + 1, bool)
    border[lower] = border[upper] = True
    some = head[lower] != 0
    lower, upper = lower[some], upper[some]
    for _ in range(1, length):
        if not len(lower):
            break
        size = upper - lower
        at = np.repeat(lower - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(lower)), size)
        to = jump[at]
        if 4 * len(to) > n:
            dense = np.full(n, -1, np.int64)
            dense[to] = owner
            to = np.flatnonzero(dense >= 0)
            owner = dense[to]
        else:
            by = np.argsort(to)
            to, owner = to[by], owner[by]
        cut = np.ones(len(to), bool)
        cut[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | turn[to[1:]]
        starts = np.flatnonzero(cut)
        low, high = to[starts], to[np.append(starts[1:], len(to)) - 1] + 1
        new = (head[low] != 0) & ~border[high]
        border[high[new]] = True
        lower, upper = low[new], high[new]
    starts = np.flatnonzero(border[:n])
    least = np.minimum.reduceat(value[order], starts)
    out = np.empty(n, np.int64)
    out[order] = np.repeat(least, np.diff(np.append(starts, n)))
    return out


def _expand(table: pa.Table) -> pa.Table:
    """For a bucket: the least document of each window of the segments that were sent, by transforms over slices of anchors."""
    metas = [np.frombuffer(zstandard.decompress(x), np.int64).reshape(3, -1) for x in table.column("meta").to_pylist()]
    bodies = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in table.column("body").to_pylist()]
    if not metas:
        return pa.table({"g": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "index": pa.array([], pa.binary()), "value": pa.array([], pa.binary())})
    size, anchor, doc = (np.concatenate([m[i] for m in metas]) for i in range(3))
    data = np.concatenate(bodies)
    begin = np.concatenate([[0], np.cumsum(size)])
    prefix_digest = K.segment_hash(K.prefix_hash(data), begin[:-1], begin[1:])
    _, first, inverse = np.unique(prefix_digest, return_index=True, return_inverse=True)
    least = np.full(len(first), NONE)
    np.minimum.at(least, inverse, doc)
    # Distinct segments in order of their anchors, in slices that never cut an anchor.
    order = np.argsort(anchor[first], kind="stable")
    ordered = first[order]
    sizes = size[ordered]
    fresh = np.concatenate([[True], anchor[ordered][1:] != anchor[ordered][:-1]])
    total = np.cumsum(sizes + 1)
    cuts, used = [0], 0
    for i in np.flatnonzero(fresh)[1:]:
        if total[i - 1] - used > SLICE:
            cuts.append(int(i))
            used = total[i - 1]
    cuts.append(len(ordered))
    windows = np.maximum(size - LENGTH + 1, 0)
    distinct_windows = windows[ordered]
    out_at = np.concatenate([[0], np.cumsum(distinct_windows)])
    result = np.empty(out_at[-1], np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = sizes[a:b]
        place = np.concatenate([[0], np.cumsum(own + 1)])
        text = np.zeros(place[-1], np.uint16)
        flat = np.repeat(begin[ordered[a:b]] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        to = np.repeat(place[:-1] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        text[to] = data[flat].astype(np.uint16) + 1
        w = distinct_windows[a:b]
        starts = np.repeat(place[:-1] - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())
        value = np.full(len(text), NONE)
        value[starts] = np.repeat(least[order[a:b]], w)
        result[out_at[a] : out_at[b]] = window_minima(text, value)[starts]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at, out = 0, []
    for g, bucket, meta in zip(table.column("g").to_pylist(), table.column("bucket").to_pylist(), metas, strict=True):
        n = meta.shape[1]
        mine = rank[inverse[at : at + n]]
        w = distinct_windows[mine]
        flat = np.repeat(out_at[mine] - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())
        out.append((g, bucket, b"", zstandard.compress(result[flat].tobytes(), 1)))
        at += n
    columns = list(zip(*out, strict=True))
    return pa.table({"g": pa.array(columns[0], pa.int64()), "bucket": pa.array(columns[1], pa.int32()), "index": pa.array(columns[2], pa.binary()), "value": pa.array(columns[3], pa.binary())})


def _removed(s: Segments, verdict: np.ndarray, windows: dict[int, np.ndarray]) -> np.ndarray:
    """Which bytes of a group are covered by windows of smaller documents."""
    ids = s.ids[s.text]
    least = np.where(verdict == NONE, s.least, verdict)
    plain = verdict[s.distinct] != OPEN
    hit = plain & (least[s.distinct] < ids)
    shift = np.zeros(len(s.data) + 1, np.int64)
    np.add.at(shift, s.start[hit], 1)
    np.add.at(shift, s.end[hit], -1)
    if not plain.all():
        opened = np.flatnonzero(verdict == OPEN)
        count = (s.end - s.start)[s.first[opened]] - LENGTH + 1
        at = np.zeros(len(verdict), np.int64)
        at[opened] = np.concatenate([[0], np.cumsum(count)[:-1]])
        bucket = np.searchsorted(s.bounds, opened, "right") - 1
        value = np.concatenate([windows[b] for b in np.unique(bucket)])
        own = np.flatnonzero(~plain)
        w = (s.end - s.start)[own] - LENGTH + 1
        step = np.arange(w.sum()) - np.repeat(np.concatenate([[0], np.cumsum(w)[:-1]]), w)
        flagged = value[np.repeat(at[s.distinct[own]], w) + step] < np.repeat(ids[own], w)
        starts = (np.repeat(s.start[own], w) + step)[flagged]
        np.add.at(shift, starts, 1)
        np.add.at(shift, starts + LENGTH, -1)
    return np.cumsum(shift)[:-1] > 0


def _finish(buckets: int, texts: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        expanded = right.filter(right.column("expanded"))
        windows = {b: np.frombuffer(zstandard.decompress(v), np.int64) for b, v in zip(expanded.column("bucket").to_pylist(), expanded.column("value").to_pylist(), strict=True)}
        settled = right.filter(pa.compute.invert(right.column("expanded")))
        for row in range(left.num_rows):
            s = _group(left, row, buckets)
            gone = _removed(s, _verdicts(settled, s), windows)
            spans = K.runs(gone, s.offsets)[2]
            for i in range(len(s.ids)):
                a, b = s.offsets[i], s.offsets[i + 1]
                kept = s.data[a:b][~gone[a:b]].tobytes()
                columns["doc_id"].append(None if s.ids[i] == _LEAST_ID else int(s.ids[i]))
                columns["n_bytes"].append(int(b - a))
                columns["n_removed"].append(int(b - a) - len(kept))
                columns["n_spans"].append(int(spans[i + 1] - spans[i]))
                columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                columns["kept"].append(kept.decode("utf-8", "replace") if texts else None)
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()})

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte is removed if a string of LENGTH bytes that covers it also starts in
    a document with a smaller id. Strings are judged on the input and never
    cross documents. ``kept`` is what remains as text (bytes of cut characters
    are replaced there, but not in the digest); it is null unless ``texts``.
    Null texts are empty. A null id counts as the smallest; rows that share an
    id don't remove each other. Columns other than those named are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    shared_dir(spark)
    read = docs.select(F.coalesce(F.col(doc_id), F.lit(_LEAST_ID)).alias("doc_id"), F.col(text).alias("text"))
    groups = keep(read.mapInArrow(_pack, "g long, ids array<long>, sizes array<long>, blob binary"))
    # About as many buckets as groups, so that a bucket is of a block's order whatever the input.
    buckets = buckets or max(16, groups.count() // 4)
    spark.conf.set(name, "16")  # a row holds a whole block; every step below runs before this is set back
    try:
        records = groups.mapInArrow(_records(buckets), "bucket int, g long, blob binary")
        verdict = "g long, bucket int, index binary, value binary"
        settled = keep(records.groupBy("bucket").applyInArrow(_settle, verdict))
        opened = groups.groupBy("g").cogroup(settled.groupBy("g")).applyInArrow(_open_segments(buckets), "bucket int, g long, meta binary, body binary")
        expanded = opened.groupBy("bucket").applyInArrow(_expand, verdict)
        known = settled.withColumn("expanded", F.lit(False)).unionAll(expanded.withColumn("expanded", F.lit(True)))
        done = groups.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(
            _finish(buckets, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
        )
        return keep(done)
    finally:
        spark.conf.set(name, before)
