"""Secret scans by character Markov models.

Two models of character pairs, one of random strings and one of ordinary
identifiers, are counted from labelled values of all documents: those found by
the contract patterns against words of the same texts. Long tokens outside the contract
spans are secrets if the mean log-likelihood ratio of the two models is above
a threshold that is calibrated on the labelled identifiers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _spans
from sparkloom.llm._base import keep, long_array

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Base64 and URL-safe characters; 64 classes and one for the token's start.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CLASSES = len(ALPHABET) + 1
MIN_LENGTH = 20
#: Mean log-likelihood ratio for each character that is asked for at least.
LEAST_RATIO = 0.25

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
_ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A whole run, taken possessively, and the form that makes it an identifier; one pattern for both would cost the square of a run's length.
_RUN = r"[A-Za-z0-9+/_=-]++"
_IDENTIFIER = r"^[A-Za-z]{3}[A-Za-z_-]{3,}+[0-9]{0,3}$"
_TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}+"
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("assign", _ASSIGN, "t rlike '(?i:password|passwd|secret|token|api_?key)'"),
    ("access", r"AKIA[A-Z0-9]++", "contains(t, 'AKIA')"),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", "t rlike '[0-9a-f]{32}'"),
    ("random", _TOKEN, f"t rlike '[A-Za-z0-9+/_=-]{{{MIN_LENGTH}}}'"),
)

_CODES = "[" + ",".join(str(ALPHABET.find(chr(i)) + 1) for i in range(128)) + "]"


def _classes(token: str) -> str:
    """Class of each character of a token: 1 to 64, or 0 for others (after URL-safe characters are mapped)."""
    mapped = f"regexp_replace(translate({token}, '-_', '+/'), '[^A-Za-z0-9+/]', '')"
    return f"transform(filter(split({mapped}, ''), x -> x <> ''), x -> element_at(codes, ascii(x) + 1))"


def _pairs(classes: str) -> str:
    """Index of each (previous class, class) pair, the start of the token being class 0."""
    return f"zip_with(concat(array(0), slice({classes}, 1, greatest(0, size({classes}) - 1))), {classes}, (a, b) -> a * {CLASSES} + b)"


def _found(docs: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` and an array of spans for each pattern; failing contract matches are gone."""
    read = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("t"))
    read = read.select(*columns, *[F.expr(_spans.pieces_and_matches("t", p, g)).alias(c) for c, p, g in PATTERNS])
    read = _spans.located(read, columns, {c: c for c in KINDS}, 1)
    good = {
        "assign": f"length(regexp_extract(s.token, {_spans.quoted(_ASSIGN_VALUE)}, 1)) >= 8",
        "access": "length(s.token) >= 16",
        "hex": "length(s.token) >= 32",
        "random": "s.token rlike '[0-9]' and s.token rlike '[A-Za-z]'",
    }
    value = {"assign": f"regexp_extract(s.token, {_spans.quoted(_ASSIGN_VALUE)}, 1)"}
    slim = lambda c: (
        f"transform(filter({c}, s -> {good[c]}), s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop, 'value', {value.get(c, 's.token')}))"
    )
    return read.select(*columns, *[F.expr(slim(c)).alias(c) for c in KINDS])


def train(docs: DataFrame, text: str = "text") -> tuple[list[float], float]:
    """Log ratio for each character pair, and the threshold.

    Labelled rows are the distinct values found by the contract patterns
    (random strings) and the distinct words of letters, with a few digits
    after them (identifiers), of all documents. Without any secret, random
    strings count as uniform. The threshold lies above all but one in a
    thousand of all identifiers, from counts in steps of a thousandth.
    """
    read = docs.select(F.col(text).alias("text"))
    codes = F.from_json(F.lit(_CODES), "array<int>").alias("codes")
    good = _found(read, "text", ()).select(F.explode(F.concat(*BASE)).alias("s")).select(F.col("s.value").alias("token"), F.lit(1).alias("y"))
    cleaned = F.regexp_replace(F.coalesce("text", F.lit("")), _ASSIGN + r"|AKIA[A-Z0-9]++|[0-9a-f]{32,}+", " ")
    words = read.select(F.explode(F.filter(F.regexp_extract_all(cleaned, F.lit(_RUN), F.lit(0)), lambda x: x.rlike(_IDENTIFIER))).alias("token"), F.lit(0).alias("y"))
    # Each value counts once, whatever its number of copies; repeats go before the shuffle.
    labelled = good.unionAll(words).distinct()
    labelled = keep(labelled.select("y", codes, "token").select("y", F.expr(_classes("token")).alias("k")).select("y", F.expr(_pairs("k")).alias("p")))
    counts = labelled.select("y", F.explode("p").alias("p")).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")).collect()
    # At most 2 * CLASSES ** 2 rows.
    table = [[0.0] * (CLASSES * CLASSES) for _ in range(2)]
    for r in counts:
        table[r["y"]][r["p"]] += r["n"]
    logs = []
    for y, own in enumerate(table):
        out = [0.0] * (CLASSES * CLASSES)
        total = sum(own)
        single = [(sum(own[a * CLASSES + b] for a in range(CLASSES)) + 1) / (total + CLASSES) for b in range(CLASSES)]
        for a in range(CLASSES):
            row = sum(own[a * CLASSES : (a + 1) * CLASSES])
            for b in range(CLASSES):
                # Pairs fall back on single characters with a weight of 8; half of the random strings are of any character.
                p = (own[a * CLASSES + b] + 8 * single[b]) / (row + 8)
                out[a * CLASSES + b] = math.log((p + 1 / len(ALPHABET)) / 2 if y else p)
        logs.append(out)
    ratio = [round(x - y, 6) for x, y in zip(logs[1], logs[0], strict=True)]
    mean = F.expr("aggregate(p, cast(0 as double), (a, x) -> a + element_at(w, x + 1)) / size(p)")
    steps = F.floor(mean * 1000).cast("int").alias("step")
    long_ = labelled.where("y = 0 AND size(p) >= 12").select("p", long_array(ratio, "double").alias("w"))
    seen = sorted((r["step"], r["n"]) for r in long_.select(steps).groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect())
    # At most some ten thousand steps, since a mean lies between the least and the largest ratio.
    above, top = sum(n for _, n in seen) // 1000, 0.0
    for step, n in reversed(seen):
        top = (step + 1) / 1000
        above -= n
        if above < 0:
            break
    return ratio, max(LEAST_RATIO, round(top + 0.05, 6))


def find_secrets(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``columns``, base and spans (arrays of kind, start, stop).

    Base spans are the contract matches that pass their length checks; spans
    adds the tokens that the Markov models call random, where these overlap no
    base span. Null texts count as empty. Rows are independent but for the
    training, so that repeated rows get equal results and null ids are
    allowed. Columns of the input other than those named are ignored.
    """
    ratio, threshold = train(docs, text)
    found = _found(docs, text, columns).select(
        *columns, *KINDS, long_array(ratio, "double").alias("w"), F.from_json(F.lit(_CODES), "array<int>").alias("codes")
    )
    slim = "named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop)"
    mean = f"aggregate({_pairs(_classes('s.value'))}, named_struct('n', 0, 't', cast(0 as double)), (a, x) -> named_struct('n', a.n + 1, 't', a.t + element_at(w, x + 1)), a -> a.t / greatest(1, a.n))"
    table = found.select(
        *columns,
        F.expr(f"transform(concat({', '.join(BASE)}), s -> {slim})").alias("b"),
        F.expr(f"transform(filter(random, s -> {mean} > {threshold!r}D), s -> {slim})").alias("m"),
    )
    table = _spans.outside(table, columns, "b", "m")
    return table.select(
        *columns, F.expr(_spans.in_order("b", KINDS, False)).alias("base"), F.expr(_spans.in_order("concat(b, m)", KINDS, False)).alias("spans")
    )


def secret_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts of base spans of each kind, their digest, and all spans, for each row."""
    found = find_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(_spans.joined("base")), 256).alias("base_sha256"),
        F.expr(_spans.joined("spans")).alias("spans"),
    )
