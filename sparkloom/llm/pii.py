"""Personal data by weak supervision.

Candidate spans come from the four contract patterns and from wider ones
(local phone numbers, national numbers, obfuscated addresses, names after a
title). Four labelers vote on each candidate: a strict format check, a
gazetteer, the words before it and the shape of its characters. Expectation
maximisation over the counts of vote patterns (a bounded table) estimates how
reliable each labeler is; its posteriors are the soft labels from which a
naive Bayes span classifier over hashed span features is trained. Spans that
pass their contract check always stay; of the others the classifier alone
decides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _spans
from sparkloom.llm._base import keep, long_array, rows_of

#: Contract kinds in their listed order, then the kinds that the method adds.
KINDS = ("email", "ip", "card", "phone", "national_id", "name")
BASE = KINDS[:4]
LABELERS = ("format", "gazetteer", "context", "shape")
FEATURES = 1024
EM_STEPS = 50

_LOCAL = "[A-Za-z0-9._%+-]"
#: Each pattern starts only where a run begins or where the last match ended, so that long runs are read once.
PATTERNS: tuple[tuple[str, str, str, str], ...] = (
    # column, kind, pattern, cheap necessary condition
    ("email", "email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')"),
    ("ip", "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "t rlike '[0-9]\\\\.[0-9]'"),
    ("card", "card", r"[0-9](?:[\x20-]?[0-9])++", "t rlike '[0-9]'"),
    ("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')"),
    ("local", "phone", r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", "t rlike '[0-9]{3}[.-][0-9]{4}'"),
    ("national", "national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "t rlike '[0-9]-[0-9]'"),
    ("at", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{1,63}+)++", "t rlike '[\\\\[(](at|AT)[\\\\])]'"),
    ("name", "name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}[\p{L}'-]+(?:\x20\p{Lu}[\p{L}'-]+)?", "t rlike '(Mr|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor)'"),
)

#: Common top-level domains, in the gazetteer of addresses.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "ai", "app", "dev", "co", "me", "tv", "cc", "eu", "de", "fr", "es", "uk", "us", "ca", "ch", "at", "be", "nl",
    "it", "pt", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "tr", "ru", "ua", "se", "no", "dk", "fi", "is", "ie", "lu", "li", "mx", "ar", "br", "cl", "pe", "au", "nz", "jp", "cn", "kr", "in", "za", "il",
)
#: Common given names in English, German, Spanish and French, in the gazetteer of names.
NAMES = (
    "james", "john", "robert", "michael", "william", "david", "richard", "joseph", "thomas", "charles", "daniel", "matthew", "anthony", "mark", "paul", "steven", "andrew", "kevin", "brian", "george",
    "mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "lisa", "nancy", "emily", "emma", "olivia", "laura", "alice", "grace", "anna", "julia",
    "peter", "hans", "klaus", "jürgen", "stefan", "andreas", "wolfgang", "markus", "lukas", "felix", "jonas", "karl", "heinz", "ursula", "monika", "sabine", "petra", "heike", "katrin", "lena",
    "josé", "carlos", "juan", "luis", "miguel", "javier", "antonio", "francisco", "manuel", "pedro", "pablo", "diego", "sofia", "maria", "carmen", "lucia", "ana", "elena", "isabel", "marta",
    "jean", "pierre", "michel", "jacques", "philippe", "nicolas", "julien", "antoine", "louis", "henri", "marie", "camille", "sophie", "claire", "nathalie", "isabelle", "céline", "chloé", "léa", "manon",
)
#: Leading digits of payment card issuers, and country calling codes.
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "56", "57", "58", "6011", "62", "63", "64", "65", "67", "22", "23", "24", "25", "26", "27")
CALLING = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65",
    "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "234", "254", "351", "352", "353", "354", "355", "356", "357", "358", "359", "370", "371", "372", "380", "385", "420", "421", "852", "886", "971", "972",
)
#: Address blocks that name no public host, by their first numbers.
SPECIAL = ("0.", "10.", "127.", "169.254.", "192.0.2.", "192.168.", "198.51.100.", "203.0.113.", "224.", "239.", "240.", "255.")
#: Words that announce personal data or its absence.
CUES = r"(?i)(e-?mail|contact|phone|tel|call|fax|mobile|card|visa|account|ssn|social security|address|ip|host|name|kontakt|telefon|correo|courriel)[^\n]{0,12}$"
ANTI_CUES = r"(?i)(version|ver\.|v|isbn|issn|section|chapter|figure|order|serial|part|page|rfc|doi|§)[\x20.:#]*$"

_DIGITS = "regexp_replace(s.token, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Sum of a digit string's Luhn weights, modulo 10."""
    return (
        f"aggregate(sequence(1, length({digits})), cast(0 as bigint), (a, i) -> a + "
        f"CASE WHEN (length({digits}) - i) % 2 = 0 THEN cast(substring({digits}, i, 1) as int) "
        f"ELSE (cast(substring({digits}, i, 1) as int) * 2) div 10 + (cast(substring({digits}, i, 1) as int) * 2) % 10 END) % 10"
    )


def _valid(digits: str = _DIGITS) -> str:
    """Whether a span passes the check of its contract kind."""
    parts = "forall(split(s.token, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(concat('0', right(x, 3)) as int) <= 255)"
    return (
        "CASE s.kind WHEN 'email' THEN true "
        f"WHEN 'ip' THEN {parts} "
        f"WHEN 'card' THEN length({digits}) between 16 and 19 and ({_luhn(digits)}) = 0 "
        f"WHEN 'phone' THEN length({digits}) between 8 and 15 ELSE false END"
    )


def _starts(text: str, listed: tuple[str, ...]) -> str:
    """Whether a text begins with one of a list."""
    widths = sorted({len(x) for x in listed})
    return "(" + " or ".join(f"left({text}, {n}) in ({', '.join(repr(x) for x in listed if len(x) == n)})" for n in widths) + ")"


def _votes() -> str:
    """A struct of the labelers' votes: 1 for personal data, -1 against, 0 to abstain."""
    listed = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
    last = "lower(regexp_extract(s.token, '([A-Za-z0-9-]+)$', 1))"
    gazetteer = (
        f"CASE s.kind WHEN 'email' THEN IF({last} in {listed(DOMAINS)}, 1, -1) "
        f"WHEN 'name' THEN IF(exists(split(lower(s.token), '[ .]+'), x -> x in {listed(NAMES)}), 1, 0) "
        f"WHEN 'card' THEN IF({_starts(_DIGITS, ISSUERS)}, 1, -1) "
        f"WHEN 'phone' THEN CASE WHEN NOT startswith(s.token, '+') THEN 0 WHEN {_starts(_DIGITS, CALLING)} THEN 1 ELSE -1 END "
        f"WHEN 'ip' THEN IF({_starts('s.token', SPECIAL)}, -1, 0) ELSE 0 END"
    )
    context = f"CASE WHEN s.before rlike {_spans.quoted(CUES)} THEN 1 WHEN s.before rlike {_spans.quoted(ANTI_CUES)} THEN -1 ELSE 0 END"
    shape = (
        f"CASE WHEN s.kind = 'name' THEN 0 WHEN s.kind = 'email' THEN CASE WHEN length(s.token) between 6 and 80 THEN 1 ELSE -1 END "
        f"WHEN size(array_distinct(split({_DIGITS}, ''))) <= 2 THEN -1 "
        "WHEN s.before rlike '[A-Za-z0-9_.#-]$' or s.after rlike '^[A-Za-z0-9_-]' THEN -1 ELSE 1 END"
    )
    form = (
        "CASE WHEN s.valid THEN 1 WHEN s.base THEN -1 WHEN s.kind = 'national_id' THEN IF(s.token rlike '^(000|666|9)|-00-|-0000$', -1, 1) "
        "WHEN s.kind = 'phone' THEN IF(s.token rlike '^[(]?[2-9]', 1, -1) ELSE 0 END"
    )
    return f"named_struct('format', {form}, 'gazetteer', {gazetteer}, 'context', {context}, 'shape', {shape})"


def _features() -> str:
    """Hashed features of a span: its form, its neighbours and each labeler's vote, with the kind."""
    shape = "regexp_replace(regexp_replace(regexp_replace(left(s.token, 24), '[0-9]+', '9'), '[A-Z]+', 'A'), '[a-z]+', 'a')"
    named = [
        ("kind", "s.kind"),
        ("shape", shape),
        ("length", "cast(length(s.token) div 4 as string)"),
        ("digits", f"cast(length({_DIGITS}) as string)"),
        ("before", "lower(regexp_extract(s.before, '([A-Za-z]+)[^A-Za-z]*$', 1))"),
        ("near", "concat(right(s.before, 1), '|', left(s.after, 1))"),
        ("valid", "concat(s.base, s.valid)"),
        *[(f"vote {x}", f"cast(s.votes.{x} as string)") for x in LABELERS],
    ]
    return "array(" + ", ".join(f"cast(pmod(xxhash64('{n}', s.kind, {x}), {FEATURES}) as int)" for n, x in named) + ")"


def candidates(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each row and its candidate spans, with their votes and features."""
    read = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("t"))
    read = read.select(*columns, *[F.expr(_spans.pieces_and_matches("t", p, guard)).alias(f"_{c}") for c, _, p, guard in PATTERNS])
    read = _spans.located(read, columns, {f"_{c}": kind for c, kind, _, _ in PATTERNS})
    fields = "'kind', s.kind, 'start', s.start, 'stop', s.stop, 'token', s.token, 'before', s.before, 'after', s.after"
    base = lambda c: f"transform(_{c}, s -> named_struct({fields}, 'base', {'true' if c in BASE else 'false'}))"
    read = read.select(*columns, F.expr("concat(" + ", ".join(base(c) for c, *_ in PATTERNS) + ")").alias("c"))
    read = read.select(*columns, F.expr(f"transform(c, s -> named_struct({fields}, 'base', s.base, 'valid', s.base and ({_valid()})))").alias("c"))
    read = read.select(*columns, F.expr(f"transform(c, s -> named_struct({fields}, 'base', s.base, 'valid', s.valid, 'votes', {_votes()}))").alias("c"))
    short = f"transform(c, s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop, 'base', s.base, 'valid', s.valid, 'votes', s.votes, 'features', {_features()}))"
    return read.select(*columns, F.expr(short).alias("c"))


def expectation_maximisation(counts: list[tuple[str, tuple[int, ...], int]], steps: int = EM_STEPS) -> dict:
    """Posterior of "personal data" for each (kind, votes), from their counts.

    Each labeler has one accuracy, kept at 0.5 to 0.98 with a weak prior of
    0.75; each kind has its own share of true candidates. Abstentions say
    nothing. The table is bounded by the number of kinds and vote patterns.
    """
    accuracy = [0.75] * len(LABELERS)
    prior = dict.fromkeys(KINDS, 0.5)
    posterior: dict = {}
    for _ in range(steps):
        for kind, votes, _n in counts:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True) if v)
            posterior[kind, votes] = 1 / (1 + math.exp(-odds))
        for j in range(len(LABELERS)):
            right, all_ = 7.5, 10.0
            for kind, votes, n in counts:
                if votes[j]:
                    p = posterior[kind, votes]
                    right += n * (p if votes[j] > 0 else 1 - p)
                    all_ += n
            accuracy[j] = min(0.98, max(0.5, right / all_))
        for kind in KINDS:
            own = [(posterior[k, v], n) for k, v, n in counts if k == kind]
            prior[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
    return posterior


def train(found: DataFrame) -> tuple[float, list[float]]:
    """Bias and weights of the span classifier, from candidates' votes and features."""
    spark = found.sparkSession
    spans = found.select(F.explode("c").alias("s")).select("s.kind", "s.votes", "s.features")
    names = [f"votes.{x}" for x in LABELERS]
    counts = [
        (r["kind"], tuple(r[x] for x in LABELERS), r["n"])
        for r in spans.groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")).collect()
    ]  # at most len(KINDS) * 3 ** len(LABELERS) rows
    counts.sort()
    posterior = expectation_maximisation(counts)
    soft = rows_of(
        spark,
        [(kind, *votes, round(p * 1_000_000)) for (kind, votes), p in posterior.items()],
        "k string, " + ", ".join(f"v{j} int" for j in range(len(LABELERS))) + ", p long",
    )
    match = F.col("kind") == F.col("k")
    for j, x in enumerate(names):
        match &= F.col(x) == F.col(f"v{j}")
    # The soft labels are millionths, so that the sums don't depend on their order.
    sums = (
        spans.join(F.broadcast(soft), match)
        .select("p", F.explode(F.concat("features", F.array(F.lit(-1)))).alias("f"))
        .groupBy("f")
        .agg(F.sum("p").alias("yes"), F.sum(1_000_000 - F.col("p")).alias("no"))
        .collect()
    )  # at most FEATURES + 1 rows
    by = {r["f"]: (r["yes"] / 1e6, r["no"] / 1e6) for r in sums}
    yes, no = by.pop(-1, (0.0, 0.0))
    weights = [0.0] * FEATURES
    for f, (a, b) in by.items():
        weights[f] = round(math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)), 6)
    return round(math.log((yes + 1) / (no + 1)), 6), weights


def scored(found: DataFrame, columns: tuple[str, ...], bias: float, weights: list[float]) -> DataFrame:
    """``columns``, the base spans and all spans of each row, by kind and start; the classifier alone decides on spans beyond the base."""
    table = found.select(*columns, "c", long_array(weights, "double").alias("w"))
    logit = f"aggregate(s.features, cast({bias!r} as double), (a, f) -> a + element_at(w, f + 1))"
    slim = "named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop)"
    table = table.select(
        *columns,
        F.expr(f"transform(filter(c, s -> s.valid), s -> {slim})").alias("b"),
        F.expr(f"transform(filter(c, s -> NOT s.base AND {logit} > 0), s -> {slim})").alias("m"),
    )
    table = _spans.outside(table, columns, "b", "m")
    return table.select(
        *columns, F.expr(_spans.in_order("b", KINDS, True)).alias("base"), F.expr(_spans.in_order("concat(b, m)", KINDS, True)).alias("spans")
    )


def find_pii(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``columns``, base and spans (arrays of kind, start, stop).

    Base spans are those of the contract patterns that pass their checks. Null
    texts count as empty and have no spans. Rows are independent of each other
    but for the corpus-wide training, so that repeated rows get equal results
    and null ids are allowed. With no candidate at all the classifier is
    neutral. Columns of the input other than those named are ignored.
    """
    found = keep(candidates(docs, text, columns))
    return scored(found, columns, *train(found))


def pii_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts of base spans of each kind, their digest, and all spans, for each row."""
    found = find_pii(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(_spans.joined("base")), 256).alias("base_sha256"),
        F.expr(_spans.joined("spans")).alias("spans"),
    )


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns stay.

    The training keeps candidates only, without texts; the texts are read once more to be changed.
    """
    trained = train(keep(candidates(docs.select(F.col(text).alias("text")), columns=())))
    found = candidates(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_text", ("_row", "_text"))
    done = _spans.redacted(scored(found, ("_row", "_text"), *trained), ("_row",), "_text", "spans")
    return done.select(*[F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
