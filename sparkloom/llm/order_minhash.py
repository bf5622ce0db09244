"""Near-duplicate detection by Order MinHash.

Each text is a sequence of runs of five words, each labelled with how often it
has occurred before. A sketch takes the ``ELL`` labelled runs with the least
hashes and keeps them in text order, so that two texts share a sketch if they
share the runs and their order. Texts with equal word sequences are one class
from the start; the classes' representatives are sorted by sketch, once for
each sketch, and linked within equal sketches to the run's least document and
then to their neighbours. A link counts if a banded alignment of the labelled
runs gives a similarity of 0.8 or more. Connected documents are one group.

Buckets whose members are then still in different groups are compared in full:
blocks of members meet each other over tasks, and every pair of two groups is
either verified or shown by a bound to be below the threshold. The bound is the
Hamming distance of two parity sketches, which no pair exceeds by more than the
shingles that it does not share. Components are found by distributed label
exchange with checkpoints.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _kernel as K
from sparkloom.shipping import ship
from sparkloom.llm._base import keep, stored

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
ELL = 3
#: Neighbours in sketch order that each document is compared with in the second pass.
REACH = 2
#: Words of 64 bits in a parity sketch, and members of a block, as dealt to tasks.
PARITY_WORDS = 32
BLOCK_ROWS = 2048
#: Closest partners of a member that the first round over open buckets verifies; later rounds take GROWTH times as many.
PARTNERS = 4
GROWTH = 8
#: Edges that one task of the component rounds takes; so few are settled in one task, without rounds.
EDGES_A_TASK = 250_000
#: Rows of ids, labels and pairs (no texts) that one task takes: small steps run as few tasks, and so write few files.
ROWS_A_TASK = 25_000
#: Texts of the asked similarity are in the same or adjacent bands of length (ln 1.25 = 0.2231).
_BAND = 0.224
_FACTORS = K.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _labelled(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all texts in order, and each text's first one.

    A text of fewer than SHINGLE words, but not none, has one shingle of all its words.
    """
    n_words = np.diff(first)
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(bounds[-1], np.uint64)
    grams = K.gram_hash(h, SHINGLE)
    long_ = n_words >= SHINGLE
    text = np.repeat(np.arange(len(n_words)), counts)
    inner = long_[text]
    at = first[:-1][text] + (np.arange(len(text)) - bounds[:-1][text])
    out[inner] = grams[at[inner]]
    for d in np.flatnonzero((n_words > 0) & ~long_):
        words = h[first[d] : first[d + 1]]
        out[bounds[d]] = K.gram_hash(words, len(words))[0] ^ np.uint64(len(words))
    key = K.mix(out + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    label = np.empty(len(key), np.uint64)
    label[order] = (np.arange(len(key)) - start).astype(np.uint64)
    return K.mix(out + label * np.uint64(0xA0761D6478BD642F)), bounds


def _sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (case of A-Z folded) and each text's first word."""
    starts, ends, first = K.runs(K.ALNUM[data], offsets)
    return K.word_hash(data, starts, ends, K.FOLDED, LOWER[data]), first


def _digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of the SHA-256 of each text's words, joined by spaces, as two integers; of the raw text where there are no words."""
    inside = K.ALNUM[data]
    starts, _, first = K.runs(inside, offsets)
    later = np.ones(len(starts), bool)
    later[first[:-1][np.diff(first) > 0]] = False
    gap = np.zeros(len(data), bool)
    gap[starts[later] - 1] = True
    kept = inside | gap
    body = np.where(gap, np.uint8(32), LOWER[data])[kept].tobytes()
    at = np.concatenate([[0], np.cumsum(kept)])[offsets].tolist()
    words = (np.diff(first) > 0).tolist()
    raw = data.tobytes()
    out = [hashlib.sha256(b"w" + body[at[i] : at[i + 1]] if words[i] else b"r" + raw[offsets[i] : offsets[i + 1]]).digest()[:16] for i in range(len(words))]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _sketches(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SKETCHES keys for each text with shingles, in rows; texts without any have no row."""
    full = np.flatnonzero(np.diff(bounds))
    starts, sizes = bounds[:-1][full], np.diff(bounds)[full]
    out = np.zeros((len(full), SKETCHES), np.uint64)
    if not len(full):
        return out
    row = np.repeat(np.arange(len(full)), sizes)
    for j in range(SKETCHES):
        value = shingles * _FACTORS[j]
        value ^= value >> np.uint64(32)
        places = np.full((len(full), ELL), len(shingles), np.int64)
        for k in range(ELL):
            least = np.minimum.reduceat(value, starts)
            at = np.flatnonzero(value == least[row])
            # Equal hashes of one text are one labelled shingle; the first one stands for it.
            texts, index = np.unique(row[at], return_index=True)
            found = least[texts] != _TOP
            places[texts[found], k] = at[index][found]
            value[at[index]] = _TOP
        places.sort(axis=1)
        key = np.full(len(full), np.uint64(j + 1))
        padded = np.concatenate([shingles, np.zeros(1, np.uint64)])
        for k in range(ELL):
            key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + padded[places[:, k]])
        out[:, j] = key
    return out


def _parities(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity sketch of each text: a bit is set if an odd number of its labelled shingles fall on it.

    Each shingle that only one of two texts has turns one bit, so that the
    Hamming distance is at most the number of unshared shingles.
    """
    n = len(bounds) - 1
    out = np.zeros(n * PARITY_WORDS, np.uint64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    bit = K.mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * PARITY_WORDS)
    np.bitwise_xor.at(out, row * PARITY_WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, PARITY_WORDS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in K.small_batches(batches, "text"):
        h, first = _sequences(data, offsets)
        n = len(offsets) - 1
        digest = _digests(data, offsets)
        words = np.diff(first)
        shingles, bounds = _labelled(h, first)
        keys = _sketches(shingles, bounds).view(np.int64)
        lists = np.full((n,), 0, np.int32)
        lists[words > 0] = SKETCHES
        empty = np.diff(offsets) == 0
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("t"),
                pa.array(digest[:, 0], mask=empty),
                pa.array(digest[:, 1]),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32)), pa.array(keys.reshape(-1))),
                pa.array(np.diff(bounds).astype(np.int32)),
            ],
            ["doc_id", "t", "h1", "h2", "keys", "n"],
        )


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of labelled shingles and parity sketch of each text."""
    for part, data, offsets in K.small_batches(batches, "text"):
        shingles, bounds = _labelled(*_sequences(data, offsets))
        n = len(offsets) - 1
        width = np.arange(n + 1, dtype=np.int32) * (8 * PARITY_WORDS)
        parity = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(width), pa.py_buffer(_parities(shingles, bounds))])
        yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(bounds).astype(np.int32)), parity], ["doc_id", "n", "parity"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, next key, document): links to the least document of the key's run and to neighbours.

    Runs that may go on in another task also name their least document, so
    that the parts can be linked afterwards. Rows of kind 3 are the members of
    runs that have, or may have, more than one.
    """
    key, doc, head = None, np.zeros(0, np.int64), True

    def emit(a, b, kind):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    least = 0
    tail = np.zeros(0, np.int64)
    for batch in batches:
        k, d = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(k):
            continue
        fresh = np.ones(len(k), bool)
        fresh[1:] = k[1:] != k[:-1]
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        shared[[0, -1]] = True
        yield emit(k[shared], d[shared], 3)
        goes_on = key is not None and k[0] == key
        starts = np.flatnonzero(fresh)
        hubs = np.minimum.reduceat(d, starts)
        if goes_on:
            # A smaller document may come later in a run; the earlier part stays linked through its own.
            if hubs[0] < least:
                yield emit([hubs[0]], [least], 0)
            hubs[0] = min(hubs[0], least)
        elif key is not None:
            if head:
                yield emit([key], [least], 2)
            head = False
        ends = np.append(starts[1:], len(k))
        hub = np.repeat(hubs, ends - starts)
        other = hub != d
        if other.any():
            yield emit(hub[other], d[other], 0)
        joined = np.concatenate([tail, d]) if goes_on else d
        jk = np.concatenate([np.full(len(tail), key, np.int64), k]) if goes_on else k
        for r in range(1, REACH + 1):
            same = (jk[r:] == jk[:-r]) & (joined[r:] != joined[:-r])
            if same.any():
                yield emit(joined[:-r][same], joined[r:][same], 1)
        if head and len(starts) > 1:
            yield emit([k[0]], [hubs[0]], 2)
            head = False
        key, least = k[-1], hubs[-1]
        tail = joined[jk == key][-REACH:]
    if key is not None:
        yield emit([key], [least], 2)


def alignment_similarity(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of two texts, from a banded alignment of labelled shingles.

    A pair at or above ``similarity`` leaves at most ``(1 - s) / (1 + s)`` of
    all shingles unaligned, which bounds how far aligned places are apart.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = total * (1 - similarity) / (1 + similarity) + 1
    near = np.abs(i - j) <= band
    order = np.argsort(i[near])
    j = j[near][order]
    if len(j) < similarity * (total - len(j)) - 1e-9:
        return len(j) / (total - len(j)) if total > len(j) else 0.0
    if (np.diff(j) > 0).all():
        length = len(j)
    else:
        ends: list[int] = []
        for x in j.tolist():
            at = bisect_left(ends, x)
            if at == len(ends):
                ends.append(x)
            else:
                ends[at] = x
        length = len(ends)
    return length / (total - length)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sides = []
            for name in ("text_a", "text_b"):
                own = []
                for _, data, offsets in K.blocks(part.column(name)):
                    shingles, bounds = _labelled(*_sequences(data, offsets))
                    own += [shingles[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
                sides.append(own)
            good = pa.array([alignment_similarity(x, y) >= SIMILARITY for x, y in zip(*sides, strict=True)])
            yield part.select(["a", "b"]).filter(good)


def _closest(end, i, j, distance, most: int):
    """The pairs that are among the ``most`` closest of their end."""
    order = np.lexsort((distance, end))
    place = np.arange(len(order)) - np.searchsorted(end[order], end[order])
    kept = order[place < most]
    return i[kept], j[kept], distance[kept]


def _close_pairs(side, label, n, parity, most: int):
    """Pairs of rows of different labels that the bound leaves, the closest first, at most ``most`` for each row as the left and as the right one; and whether there are others.

    Held at once are the pairs of 32 rows with a block, and ``most`` for each row of it.
    """
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    within = not len(right)
    if within:
        right = left
    total = 0
    none = np.zeros(0, np.int64)
    chosen, by_right = [], (none, none, none)
    for at in range(0, len(left), 32):
        a = left[at : at + 32]
        apart = label[a][:, None] != label[right][None]
        limit = (n[a][:, None] + n[right][None]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
        apart &= np.abs(n[a][:, None] - n[right][None]) <= limit
        if within:
            apart &= a[:, None] < right[None]
        i, j = np.nonzero(apart)
        found = []
        for part in range(0, len(i), 1 << 14):
            x, y = i[part : part + (1 << 14)], j[part : part + (1 << 14)]
            distance = np.bitwise_count(parity[a[x]] ^ parity[right[y]]).sum(axis=1, dtype=np.int64)
            good = distance <= limit[x, y]
            found.append((a[x[good]], right[y[good]], distance[good]))
        if not found:
            continue
        x, y, distance = (np.concatenate(c) for c in zip(*found, strict=True))
        total += len(x)
        chosen.append(_closest(x, x, y, distance, most)[:2])
        x, y, distance = (np.concatenate(c) for c in zip(by_right, (x, y, distance), strict=True))
        by_right = _closest(y, x, y, distance, most)
    i, j = (np.concatenate(c) for c in zip(by_right[:2], *chosen, strict=True))
    pairs = np.unique(i * len(side) + j) if len(i) else none
    return pairs // max(1, len(side)), pairs % max(1, len(side)), len(pairs) < total


def _compare(most: int):
    """From rows sorted by block pair: candidates (kind 0), and one row of kind 1 if some were left for later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, more = None, False

        def pairs(block):
            nonlocal more
            _, side, label, doc, n, parity = block
            i, j, cut = _close_pairs(side, label, n, parity, most)
            more |= cut
            a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int32))], ["a", "b", "kind"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY_WORDS)
            names = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("k", "lo", "i", "hi", "j")], axis=1)
            block = [names, *[np.asarray(batch.column(c)).astype(np.int64) for c in ("side", "label", "doc_id", "n")], bits]
            if carried is not None:
                block = [np.concatenate(x) for x in zip(carried, block, strict=True)]
            starts = np.flatnonzero((block[0][1:] != block[0][:-1]).any(axis=1)) + 1
            bounds = [0, *starts.tolist()]
            for x, y in zip(bounds, bounds[1:], strict=False):
                yield pairs([c[x:y] for c in block])
            carried = [c[bounds[-1] :] for c in block]
        if carried is not None:
            yield pairs(carried)
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([1], pa.int32())], ["a", "b", "kind"])

    return run


def _fit(df: DataFrame, rows: int) -> DataFrame:
    """As few tasks as ``rows`` narrow rows need; a table that needs all of them stays as it is."""
    tasks = -(-rows // ROWS_A_TASK) or 1
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _open_pairs(members: DataFrame, n_members: int, cut: DataFrame, label: DataFrame, sketched: DataFrame, most: int) -> DataFrame:
    """(a, b, kind) from ``_compare``, for the buckets whose members have different labels.

    Buckets of three members that no task boundary cuts were compared in full
    by the neighbour pass.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = lambda df: _fit(df, n_members)
    known = keep(fit(members.join(label.toDF("doc_id", "l"), "doc_id", "left").select("k", "doc_id", F.coalesce("l", "doc_id").alias("label"))))
    sizes = fit(known.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"))).where("lo < hi")
    opened = fit(sizes.join(cut.select("k", F.lit(True).alias("was_cut")), "k", "left")).where("m > 3 OR was_cut").select("k")
    rows = keep(
        fit(fit(known.join(opened, "k", "left_semi")).join(sketched, "doc_id"))
        .select("k", "doc_id", "label", "n", "parity", F.floor(F.log("n") / F.lit(_BAND)).cast("int").alias("band"))
    )
    counts = fit(rows.groupBy("k", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("cells")))
    # At most one entry for each band of length.
    cells = fit(counts.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("band", "cells"))).alias("cells")))
    pair = "named_struct('lo', {}, 'i', {}, 'hi', {}, 'j', {}, 'side', {})"
    same = pair.format("band", "least(own, x)", "band", "greatest(own, x)", "IF(own > x, 1, 0)")
    above = pair.format("band", "own", "band + 1", "x", "0")
    below = pair.format("band - 1", "x", "band", "own", "1")
    listed = lambda at, what: f"transform(IF(coalesce(cells[{at}], 0) > 0, sequence(0, cells[{at}] - 1), cast(array() as array<int>)), x -> {what})"
    dealt = (
        fit(rows.join(cells, "k"))
        .withColumn("own", F.expr("cast(pmod(xxhash64(doc_id), cells[band]) as int)"))
        .select("k", "label", "doc_id", "n", "parity", F.explode(F.expr(f"concat({listed('band', same)}, {listed('band + 1', above)}, {listed('band - 1', below)})")).alias("x"))
        .select("k", "x.*", "label", "doc_id", "n", "parity")
    )
    names = ("k", "lo", "i", "hi", "j")
    return fit(keep(dealt.repartition(parts, *names).sortWithinPartitions(*names).mapInArrow(_compare(most), "a long, b long, kind int"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of a bounded number of edges: labels sink to the least node of each end until nothing changes."""
    held = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches if b.num_rows]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(new, side, least)
            # The old label of an end stands for its whole part.
            np.minimum.at(new, label[side], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label): the least node of each connected component, for the nodes of ``edges`` (a, b).

    Alternates exchanges in which every node links its larger and then its
    smaller neighbours to its least one, which needs few rounds for any shape.
    Each round is checkpointed, and has as many tasks as its edges need; up to
    EDGES_A_TASK edges are settled in one task.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if edges.count() <= EDGES_A_TASK:
        ship(edges.sparkSession)
        return keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").coalesce(1).mapInArrow(_joined, "node long, label long"))
    edges = keep(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first())

    now = state(edges)
    for _ in range(rounds):
        tasks = -(-now[0] // EDGES_A_TASK) or 1
        fit = lambda df: df.coalesce(tasks) if tasks < parts else df  # noqa: B023, E731
        edges = fit(edges)
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = fit(both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.col("x")).alias("m")))
        # Large star: larger neighbours go to the least neighbour.
        large = fit(edges.join(least, F.col("v") == F.col("x")).select(F.col("m").alias("v"), "u").where("u <> v").distinct())
        # Small star: a node and its smaller neighbours go to the least of them.
        small = fit(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")))
        turned = large.join(small, F.col("u") == F.col("x"))
        linked = turned.select(F.col("m").alias("p"), F.explode(F.array("u", "v")).alias("q")).where("p <> q")
        edges = stored(fit(linked.select(F.least("p", "q").alias("v"), F.greatest("p", "q").alias("u")).distinct()))
        new = state(edges)
        if new == now:
            break
        now = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of nodes whose texts align."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return keep(pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))


def _grouped(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The columns of ``near_duplicates``, with the digest ``t`` of each row's text."""
    ship(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    schema = "doc_id long, t long, h1 long, h2 long, keys array<long>, n int"
    # Rows get numbers of their own, so that rows without an id or with a repeated one stay apart.
    signed = keep(read.mapInArrow(_signatures, schema).withColumn("row", F.monotonically_increasing_id()))
    n_rows = signed.count()
    fit = lambda df: _fit(df, n_rows)
    signed = fit(signed)
    # Kept apart from the join: on one exchange with it, the copies of a text could not be split over tasks.
    reps = keep(fit(signed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min_by("row", "doc_id").alias("rep"))))
    named = keep(
        fit(signed.join(reps, ["h1", "h2"], "left"))
        .withColumn("node", F.coalesce("rep", "row"))
        .select("doc_id", "t", "row", "node", *[F.when(F.col("row") == F.col("node"), F.col(c)).alias(c) for c in ("keys", "n")])
    )
    keys = named.where("row = node AND n > 0").select(
        F.col("node").alias("doc_id"), F.explode(F.expr("zip_with(keys, concat(slice(keys, 2, size(keys)), slice(keys, 1, 1)), (k, n) -> struct(k, n))")).alias("x")
    )
    ordered = keep(keys.select("x.k", "doc_id", "x.n"))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    links = ordered.repartitionByRange(int(parts), "k", "n", "doc_id").sortWithinPartitions("k", "n", "doc_id").mapInArrow(_neighbours, "a long, b long, kind int")
    links = keep(_fit(links.distinct(), n_rows * SKETCHES // 4))
    found = {r["kind"]: r["count"] for r in links.groupBy("kind").count().collect()}  # four kinds
    n_members = found.get(3, 0)
    members = links.where("kind = 3").select(F.col("a").alias("k"), F.col("b").alias("doc_id"))
    # Only texts that share a bucket are moved, once; rows that repeat an id and its text are one text.
    ends = _fit(members.select(F.col("doc_id").alias("node")).distinct(), n_members)
    sought = fit(named.where("row = node").select("doc_id", "t", "node").join(ends, "node", "left_semi"))
    texts = keep(read.join(sought, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("node", "text"))
    # Parts of one run in several tasks: their least documents are linked to the least of all.
    cut = links.where("kind = 2").select(F.col("a").alias("k"), F.col("b").alias("d"))
    across = cut.join(cut.groupBy("k").agg(F.min("d").alias("m")), "k").where("d <> m").select(F.col("m").alias("a"), F.col("d").alias("b"))
    stars = links.where("kind = 0").select("a", "b").unionAll(_fit(across, found.get(2, 0)))
    n_stars = found.get(0, 0) + found.get(2, 0)
    stars = keep(_fit(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n_stars))
    first = _fit(_checked(stars, texts), n_stars)
    label = components(first)
    # Neighbours that are still in different groups are compared as well.
    n_near = found.get(1, 0)
    near = _fit(links.where("kind = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n_near)
    la, lb = label.toDF("a", "la"), label.toDF("b", "lb")
    apart = _fit(_fit(near.join(la, "a", "left"), n_near).join(lb, "b", "left"), n_near).where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    apart = keep(_fit(apart.join(stars, ["a", "b"], "left_anti"), n_near))
    edges = first.unionAll(_fit(_checked(apart, texts), n_near))
    label = components(edges)
    # Buckets that still hold several groups: all pairs of two groups, the closest ones first.
    parted = _fit(cut.groupBy("k").agg(F.count(F.lit(1)).alias("m")), found.get(2, 0)).where("m > 1")
    sketched = _fit(keep(texts.mapInArrow(_sketched, "doc_id long, n int, parity binary")), n_rows)
    tested, most = stars.unionAll(apart), PARTNERS
    while True:
        candidates = _open_pairs(members, n_members, parted, label, sketched, most)
        candidates = keep(candidates)
        fresh = keep(_fit(candidates.where("kind = 0").select("a", "b").join(tested, ["a", "b"], "left_anti"), n_members))
        if n_fresh := fresh.count():
            edges = edges.unionAll(_fit(_checked(fresh, texts), n_fresh))
            tested = tested.unionAll(fresh)
            label = components(edges)
        if not candidates.where("kind = 1").limit(1).count():
            break
        most *= GROWTH
    degree = fit(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links")))
    nodes = fit(label.join(degree, "node", "full_outer")).select("node", F.coalesce("label", "node").alias("label"), "links")
    rows = fit(named.select("doc_id", "t", "row", "node").join(nodes, "node", "left")).select(
        "doc_id", "t", "row", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("n_links")
    )
    rows = keep(rows)
    sizes = keep(
        fit(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_members"), F.min("doc_id").alias("class_id"), F.min_by("row", "doc_id").alias("own")))
    )
    real = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    return rows.join(sizes, "label").select(
        real("doc_id"), "t", real("class_id"), "n_members", "n_links", (F.col("row") == F.col("own")).alias("representative")
    )


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, class_id, n_members, n_links, representative.

    ``class_id`` is the least doc_id of the group, ``n_members`` the group's
    rows, ``n_links`` the verified links of the row's text to other texts
    (copies count as one text), ``representative`` marks the class's own row.
    Words are runs of letters, digits and characters outside ASCII, A-Z
    lower-cased. Texts without words are alike only if equal; null and empty
    texts are alone. A null doc_id counts as the least possible id. Rows that
    share an id are told apart by their text; groups whose least ids are equal
    have the same class_id, but are counted apart and have a representative
    each. Columns other than those named are ignored.
    """
    return _grouped(docs, text, doc_id).drop("t")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The document with the least id of each group, once, with all its columns.

    Documents without an id or with a repeated one are told apart by their
    text; of rows that repeat both, one stays.
    """
    classes = _grouped(docs, text, doc_id).where("representative").select(F.col("doc_id").alias("kept"), F.col("t").alias("kept_t")).distinct()
    # The row travels as one struct, so that its columns may have any name.
    found = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    kept = found.join(classes, F.col("id").eqNullSafe(F.col("kept")) & (F.col("t") == F.col("kept_t")), "left_semi")
    order = Window.partitionBy("id", "t").orderBy(F.col("text").asc_nulls_last())
    first = kept.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
