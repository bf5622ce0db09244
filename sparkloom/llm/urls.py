"""URL filters: host and path rules, and a character language-model ratio.

URLs that a rule decides are labelled examples, each distinct one once. Two
variable-order Markov models, of accepted and of rejected URLs, are counted
from four in five of them, table by table in the tasks and summed by Spark;
each order is smoothed towards the next lower one. A URL without a rule is
judged by the difference of the two log-likelihoods for each character, against
a threshold calibrated on the rest of the examples, all of which are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _kernel as K
from sparkloom.shipping import ship
from sparkloom.llm._base import best_cut, keep, lower_ascii

#: Fixed values of the contract: verdict, host, path.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 5
TABLE = 1 << 16
#: How much the next lower order counts.
BACKOFF = 4.0
#: One labelled URL in this many, by hash, is held out of the models for the threshold.
HELD_OUT = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3, length(url))")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _contexts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of the characters before each byte; a text's start is a character of its own."""
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    out, h = [], np.full(len(data), 1, np.uint64)
    out.append(h.copy())
    for k in range(1, ORDER):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k] if len(data) > k else before[k:]
        before = np.where(place >= k, before + np.uint64(2), np.uint64(1))
        h = K.mix(h * np.uint64(0x100000001B3) + before)
        out.append(h.copy())
    return out


def _slots(data: np.ndarray, contexts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    shift = np.uint64(48)
    return [((K.mix(c + data * np.uint64(0x9E3779B1)) >> shift).astype(np.int64), (K.mix(c ^ np.uint64(77)) >> shift).astype(np.int64)) for c in contexts]


class Model:
    """Counts of one class of URLs: of contexts with the next character, and of contexts."""

    def __init__(self) -> None:
        self.counts = np.zeros((2, ORDER, TABLE), np.int64)

    @property
    def both(self) -> np.ndarray:
        return self.counts[0]

    @property
    def context(self) -> np.ndarray:
        return self.counts[1]

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        for k, (both, context) in enumerate(_slots(data, _contexts(data, offsets))):
            self.both[k] += np.bincount(both, minlength=TABLE)
            self.context[k] += np.bincount(context, minlength=TABLE)

    def log_likelihood(self, data: np.ndarray, slots: list) -> np.ndarray:
        p = np.full(len(data), 1 / 256)
        for k, (both, context) in enumerate(slots):
            p = (self.both[k][both] + BACKOFF * p) / (self.context[k][context] + BACKOFF)
        return np.log(p)


def scores(accepted: Model, rejected: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference for each character; 0 for empty texts."""
    n = len(offsets) - 1
    slots = _slots(data, _contexts(data, offsets))
    gain = accepted.log_likelihood(data, slots) - rejected.log_likelihood(data, slots)
    text = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(text, weights=gain, minlength=n) / np.maximum(np.diff(offsets), 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of both classes, one set for each task; a slot is its place in the table of (class, both or context, order)."""
    accepted, rejected = Model(), Model()
    for part, data, offsets in K.small_batches(batches, "u"):
        good = np.asarray(part.column("good"))
        of = np.repeat(good, np.diff(offsets))
        for model, own, mine in ((accepted, good, of), (rejected, ~good, ~of)):
            model.add(data[mine], np.concatenate([[0], np.cumsum(np.diff(offsets)[own])]))
    counts = np.stack([accepted.counts, rejected.counts]).ravel()
    at = np.flatnonzero(counts)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])


def _models(known: DataFrame) -> tuple[Model, Model]:
    """The models of all rows of ``known`` (u, good)."""
    sums = known.mapInArrow(_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 4 * ORDER * TABLE rows
    accepted, rejected = Model(), Model()
    counts = np.zeros((2, *accepted.counts.shape), np.int64)
    counts.ravel()[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    accepted.counts, rejected.counts = counts
    return accepted, rejected


def train(judged: DataFrame) -> tuple[Model, Model, float, float]:
    """Both models, the threshold, and the mean accuracy of the two classes on held-out rows.

    ``judged`` has host, path and verdict (null where no rule decides). The
    threshold has the best mean of the two classes' accuracies; it is 0 without
    held-out rows of both.
    """
    ship(judged.sparkSession)
    # Once in the shared folder: three jobs read it.
    known = keep(judged.where("verdict IS NOT NULL").select(F.concat("host", "path").alias("u"), (F.col("verdict") == "allow").alias("good")).distinct())
    held = F.pmod(F.xxhash64("u"), F.lit(HELD_OUT)) == 0
    accepted, rejected = _models(known.where(~held))
    models = judged.sparkSession.sparkContext.broadcast((accepted, rejected))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in K.small_batches(batches, "u"):
            yield pa.RecordBatch.from_arrays([pa.array(scores(*models.value, data, offsets)), part.column("good")], ["score", "good"])

    scored = keep(known.where(held).mapInArrow(run, "score double, good boolean"))
    cut = best_cut(scored)
    if not cut:
        least = 0.0
    elif None in cut:
        least = float(np.nextafter(cut[1], -np.inf) if cut[0] is None else np.nextafter(cut[0], np.inf))
    else:
        least = (cut[0] + cut[1]) / 2
    right = scored.groupBy("good").agg(F.avg(((F.col("score") >= F.lit(least)) == F.col("good")).cast("int")).alias("right"))
    found = {r["good"]: r["right"] for r in right.collect()}
    return accepted, rejected, least, (found.get(True, 1.0) + found.get(False, 1.0)) / 2


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", page_id: str = "page_id"
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    A null URL, or one without ``://``, has an empty host and path and no
    rule; its score is 0. With no labelled URL every score is 0 and allowed.
    Rows are independent but for the training; null ids and repeated rows are
    allowed. Columns other than those named are ignored.
    """
    ship(pages.sparkSession)
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    split = read.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    accepted, rejected, least, _ = train(judged)
    models = pages.sparkSession.sparkContext.broadcast((accepted, rejected))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in K.small_batches(batches, "address"):
            score = scores(*models.value, data, offsets)
            says = part.column("verdict").to_pylist()
            verdict = [x or ("allow" if s >= least else "block") for x, s in zip(says, score.tolist(), strict=True)]
            arrays = [part.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(verdict, pa.string()), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

    with_address = judged.withColumn("address", F.concat("host", "path"))
    return with_address.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
