"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed runs of bytes: one of trusted
texts (labelled good), one of the whole corpus. A text's score is the mean of
its n-grams' log ratios, so that long and short texts compare. The threshold
is calibrated once on labelled rows and then decides on every document.

Every document counts for the corpus, every document labelled good for the
trusted side, and every labelled document for the calibration. Counts are
gathered as at most ``BUCKETS`` rows from each task and summed by Spark; the
threshold is found over scores in order, range by range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _kernel as K
from sparkloom.llm._base import best_cut, stored
from sparkloom.shipping import ship

BUCKETS = 1 << 15
GRAM = 4
#: Trusted ids up to this many are sent to the texts; more of them are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: How much worse it is to lose a trusted document than to keep a rejected one.
TRUSTED_COST = 50
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of GRAM bytes inside one text, and the text of each."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint32)
    for j in range(GRAM):
        value = (value << np.uint32(8)) | data[j : j + n]
    bucket = ((value * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    sizes = np.diff(offsets)
    whole = np.maximum(sizes - GRAM + 1, 0)
    inside = np.ones(n, bool)
    for j in range(1, GRAM):  # runs that start too near a text's end cross it
        at = offsets[1:] - j
        at = at[(at >= 0) & (at < n)]
        inside[at] = False
    if inside.sum() != whole.sum():  # texts shorter than GRAM need the plain way
        text = np.repeat(np.arange(len(sizes)), sizes)[:n]
        inside = text == np.repeat(np.arange(len(sizes)), sizes)[GRAM - 1 :]
    return bucket[inside], np.repeat(np.arange(len(sizes)), whole)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams by bucket, one set for each task."""
    counts = np.zeros(BUCKETS, np.int64)
    for _, data, offsets in K.small_batches(batches, "text"):
        counts += np.bincount(_gram_buckets(data, offsets)[0], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])


def _scores(ratio: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    bucket, text = _gram_buckets(data, offsets)
    n = len(offsets) - 1
    return np.bincount(text, weights=ratio[bucket], minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    inside = ~K.SPACE[data]
    starts, ends, first = K.runs(inside, offsets)
    counts = {
        "n_words": np.diff(first),
        "word_chars": K.per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": K.per_text(_SYMBOL[data], offsets),
    }

    l_starts, l_ends, l_first = K.runs(data != 10, offsets)
    # A word may have begun before the line only if it holds the line break, which no word does.
    has_word = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    line_text, l_starts, l_ends = K.in_text(l_first)[has_word], l_starts[has_word], l_ends[has_word]
    order, again = _repeats(data, K.word_hash(data, l_starts, l_ends), line_text, l_starts, l_ends)
    counts["n_dup_lines"] = np.bincount(line_text[order[1:][again]], minlength=n)

    text = K.in_text(first)
    # Words by number, so that equal numbers are equal words and not only equal hashes.
    order, again = _repeats(data, K.word_hash(data, starts, ends), np.zeros_like(text), starts, ends)
    number = np.empty(len(starts), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], ~again])) if len(order) else number
    whole = np.flatnonzero(text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :]) if len(text) >= WINDOW else np.zeros(0, np.int64)
    grams = np.stack([text[whole], *[number[whole + j] for j in range(WINDOW)]])
    order = np.lexsort(grams[::-1])
    same = (grams[:, order[1:]] == grams[:, order[:-1]]).all(axis=0) if len(order) else np.zeros(0, bool)
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts) + 1, np.int32)
    np.add.at(covered, whole[twice], 1)
    np.add.at(covered, whole[twice] + WINDOW, -1)
    hit = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
    counts["n_repeat_words"] = np.diff(np.searchsorted(hit, first))
    return counts


def _repeats(data: np.ndarray, key: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal segments of a text follow each other, and whether each one equals the one before it.

    Segments are ordered by hash and length; where bytes of one hash differ
    after all, those segments are ordered by their bytes.
    """
    size = ends - starts
    order = np.lexsort((size, key, text))
    x, y = order[:-1], order[1:]
    near = (key[x] == key[y]) & (size[x] == size[y]) & (text[x] == text[y])
    again = near.copy()
    again[near] = K.equal_bytes(data, starts[x[near]], starts[y[near]], size[x[near]])
    if (again != near).any():
        run = np.concatenate([[0], np.cumsum(~near)])
        for r in np.unique(run[1:][again != near]):
            at = np.flatnonzero(run == r)
            order[at] = sorted(order[at], key=lambda i: data[starts[i] : ends[i]].tobytes())
            again[at[1:] - 1] = [data[starts[i] : ends[i]].tobytes() == data[starts[j] : ends[j]].tobytes() for i, j in zip(order[at], order[at[1:]])]
    return order, again


def _labels(labels: DataFrame) -> DataFrame:
    """Each labelled id once, with its lowest label."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))


def _ratio(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, bool]:
    """Log ratio of each bucket, and whether any trusted n-gram was seen."""
    ship(docs.sparkSession)
    good = _labels(labels).where("q = 1").select("doc_id")
    if good.count() <= MOST_BROADCAST:
        good = F.broadcast(good)
    counted = lambda rows, kind: rows.select("text").mapInArrow(_counts, "bucket long, n long").withColumn("good", F.lit(kind))
    sums = (
        counted(docs, False).unionAll(counted(docs.join(good, "doc_id"), True))
        .groupBy("bucket").agg(F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("raw"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"))
        .toPandas()
    )  # at most BUCKETS rows
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if len(sums):
        raw[sums["bucket"]] = sums["raw"]
        trusted[sums["bucket"]] = sums["good"]
    # The trusted multinomial backs off to the corpus, so that n-grams it hasn't seen count as rare, not impossible.
    share = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    weight = max(1.0, 0.01 * trusted.sum())
    return np.log((trusted + weight * share) / (trusted.sum() + weight)) - np.log(share), bool(trusted.sum())


def threshold(scores: DataFrame, labels: DataFrame, cost: int = TRUSTED_COST) -> float:
    """The cut with the least cost of lost trusted and kept rejected rows; of equal cuts the lowest, placed midway.

    ``scores`` has doc_id and score of all documents; those labelled 0 or 1 decide.
    """
    cut = best_cut(scores.join(_labels(labels).where("q IN (0, 1)"), "doc_id").select("score", (F.col("q") == 1).alias("good")), cost)
    if not cut or cut[0] is None:
        return -np.inf
    below, at = cut
    return float(below + (at - below) / 2) if at is not None else float(np.nextafter(below, np.inf))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio of each bucket, and the least score that is kept.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality. Without
    trusted or without rejected labels nothing can be told apart, and the
    threshold is minus infinity.
    """
    ratio, seen = _ratio(docs, labels)
    if not seen:
        return ratio, -np.inf
    known = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in K.small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(known.value, data, offsets))], ["doc_id", "score"])

    return ratio, threshold(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double"), labels)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Null and empty texts have no words and so fail the base rules. A text
    without n-grams scores 0. Repeated rows get equal results; null ids are
    allowed and never count as labelled. Of several labels for an id the
    lowest holds. Columns other than those named are ignored. The counts and
    scores are written once, to the shared folder; the threshold follows from
    the scores among them.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ratio, seen = _ratio(read, labels)
    ratio = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in K.small_batches(batches, "text"):
            c = base_counts(data, offsets)
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            score = _scores(ratio.value, data, offsets)
            arrays = [part.column("doc_id"), *[pa.array(v.astype(np.int64)) for v in c.values()]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(failed), pa.array(score)], ["doc_id", *c, "base_failed", "score"])

    judged = stored(
        read.mapInArrow(
            run,
            "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, score double",
        )
    )
    least = threshold(judged.select("doc_id", "score"), labels) if seen else -np.inf
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float(least))))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that pass the rules, with all their columns; decided row by row, without a join."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ratio, least = train(read, labels)
    ratio = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in K.small_batches(batches, text):
            c = base_counts(data, offsets)
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            good = ~failed & (_scores(ratio.value, data, offsets) >= least)
            if good.any():
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
