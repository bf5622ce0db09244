"""Text functions: hashing, chunking, tags, keywords, facts, previews, HTML.

Column expressions where SQL functions can say it; Arrow functions for the
stateful ones. Fixed values (word lists, patterns) are stated as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions._regex import ascii_bounds
from sparkloom.functions import _plain as P
from sparkloom.functions._plain import STOPWORDS, TECH_TAGS
from sparkloom.functions._stem import stem
from sparkloom.shipping import ship

# --- hashes and simple expressions -------------------------------------------------------------------------


def content_hash(content: Column, normalise: bool = True) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(content), r"(?U)\s+", " ")) if normalise else content
    return F.sha2(flat, 256)


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.lower(query)), 256), 1, 16)


def strip_private(content: Column) -> Column:
    return F.trim(F.regexp_replace(content, r"(?is)<private>.*?</private>", ""))


def estimate_tokens(content: Column) -> Column:
    return F.ceil(F.length(content) / 4)


def similarity(a: Column, b: Column) -> Column:
    """Edit distance over the longer length, as a likeness from 0 to 1."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / most)


# Spellings of tags that stand for one tag.
TAG_ALIASES = {"nextjs": "next.js", "next-js": "next.js", "reactjs": "react"}


def canonical_tag(tag: Column, aliases: dict[str, str] | None = None) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), "[ _]+", "-"), "^-+|-+$", "")
    pairs = {**TAG_ALIASES, **(aliases or {})}
    mapped = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    return F.coalesce(mapped[flat], flat)


def canonical_tags(tags: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical tags in their first order, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: canonical_tag(t, aliases)), lambda t: t != ""))


def slug(text: Column, width: int = 80) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(flat, "^-+|-+$", ""), 1, width), "-+$", "")


def sentences(text: Column) -> Column:
    """Sentence-like parts of 10 to 500 characters, list and heading marks removed; long lines are cut after full stops."""
    lines = F.split(text, r"\n+")
    parts = F.flatten(F.transform(lines, lambda s: F.when(F.length(s) > 200, F.split(s, r"(?<=[.!?])\s+")).otherwise(F.array(s))))
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"^[\s\-*>#]+", "")))
    return F.filter(clean, lambda s: F.length(s).between(10, 500))


# Words that don't count when two sentences are compared.
OVERLAP_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "that", "this", "was", "are", "be", "has", "had", "have", "not", "no", "can", "will", "do",
    "did", "should", "would", "could", "may", "might", "we", "you", "he", "she", "they", "its", "our", "my", "your", "all", "each", "some", "than", "too", "very", "just", "also", "been", "being", "into",
    "out", "so", "then", "there", "these", "those", "when", "where", "which", "while", "who", "how", "what", "new", "use", "used", "using", "one", "two",
)


def content_words(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop)))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared content words over the smaller set."""
    x, y = content_words(a, OVERLAP_STOPWORDS), content_words(b, OVERLAP_STOPWORDS)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def smart_preview(content: Column, query: Column, width: int = 200) -> Column:
    """The sentence that holds most query words, the first of equals."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: F.length(t) > 2)
    parts = F.filter(F.split(content, r"(?<=[.!?\n])\s+"), lambda s: F.length(F.trim(s)) > 0)
    scored = F.transform(parts, lambda s, i: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.lower(s), t))).alias("n"), (-i).alias("i"), F.trim(s).alias("s")))
    best = F.array_max(scored)["s"]
    return F.when(F.length(content) <= width, content).otherwise(F.substring(best, 1, width))


# Query words that are left out of full-text search.
QUERY_STOPWORDS = (
    "what", "when", "where", "who", "how", "did", "was", "the", "are", "has", "have", "does", "can", "will", "about", "with", "from", "that", "this", "for", "you", "your",
    "would", "could", "should", "some", "any", "been", "being", "more", "also", "into", "than", "then", "there", "their", "which", "were", "they", "them", "very", "just",
    "but", "not", "all", "its", "his", "her", "our", "she", "him", "had", "may", "might", "still", "recommend", "suggest", "give", "tell",
)


def query_terms(query: Column, most: int = 10) -> Column:
    """Words of a query without special characters and stop words (all of them if nothing else is left)."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(query, r"""['"(){}\[\]*:^~!@#$%&\\]""", " "), r"\s+", " "))
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*QUERY_STOPWORDS))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(words), 1, most)


# --- tags, keywords, topics --------------------------------------------------------------------------------

# Topics and the words that show them.
TOPIC_TAGS = (
    ("decision", r"(?i)\b(?:decided|decision|chose|choosing|trade-?off)\b"),
    ("lesson", r"(?i)\b(?:lesson|learned|insight|takeaway|realization)\b"),
    ("performance", r"(?i)\b(?:perf(?:ormance)?|optimi[sz](?:e|ation)|slow|fast|latency|benchmark)\b"),
    ("deployment", r"(?i)\b(?:deploy(?:ment)?|ci/cd|pipeline|release|ship(?:ping)?)\b"),
    ("testing", r"(?i)\b(?:test(?:ing|s)?|spec|coverage|assertion|mock)\b"),
    ("refactor", r"(?i)\b(?:refactor(?:ing|ed)?|cleanup|reorgani[sz]e|restructure)\b"),
    ("security", r"(?i)\b(?:secur(?:ity|e)|auth(?:entication)?|vulnerabilit(?:y|ies)|xss|csrf|injection)\b"),
)
# Hyphenated words that are no project names.
COMMON_COMPOUNDS = (
    "built-in", "real-time", "re-use", "re-run", "pre-commit", "pre-build", "post-build", "non-null", "non-empty", "up-to-date", "end-to-end", "out-of-date", "day-to-day", "step-by-step",
    "case-by-case", "long-term", "short-term", "high-level", "low-level", "run-time", "compile-time", "read-only", "write-only", "read-write", "key-value", "open-source", "third-party",
    "cross-platform", "single-page", "multi-line", "auto-generated", "well-known", "hard-coded", "type-safe", "first-class", "self-hosted", "hot-reload", "de-duplicate", "re-embed",
)


def auto_tags(content: Column, most: int = 3) -> Column:
    """Up to three tags: technology words in text order, then topics, then hyphenated project names."""
    literal = lambda words: F.array(*[F.lit(w) for w in words])
    tech = F.array_intersect(F.split(F.lower(content), r"""[\s,.:;!?()\[\]{}"'`/\\]+"""), literal(TECH_TAGS))
    topics = F.array_compact(F.array(*[F.when(content.rlike(ascii_bounds(p)), tag) for tag, p in TOPIC_TAGS]))
    names = F.regexp_extract_all(content, F.lit(ascii_bounds(r"\b([a-z][a-z0-9]*(?:-[a-z0-9]+)+)\b")), F.lit(1))
    names = F.filter(F.array_except(names, literal(COMMON_COMPOUNDS)), lambda n: F.length(n).between(3, 30))
    return F.slice(F.array_distinct(F.concat(tech, topics, names)), 1, most)


def _arrow(kind: str, run):
    """An Arrow function, made when it is used, with this package on the workers."""
    ship(SparkSession.active())
    return F.pandas_udf(run, kind)


def keywords(content, tags, names) -> Column:
    """Search keywords in order of discovery, up to 200 characters: names, tags, technology words, proper nouns, compounds, aliases."""

    def run(content: pd.Series, tags: pd.Series, names: pd.Series) -> pd.Series:
        items = lambda x: list(x) if x is not None else []
        return pd.Series([P.keywords(c or "", items(t), items(n)) for c, t, n in zip(content, tags, names, strict=True)])

    return _arrow("string", run)(content, tags, names)


# --- chunks and sections -----------------------------------------------------------------------------------


def stems(word) -> Column:
    """Porter stems; distinct words should be stemmed once and joined back."""

    def run(word: pd.Series) -> pd.Series:
        return word.map(lambda w: None if w is None else stem(w))

    return _arrow("string", run)(word)


def chunks(text, target: int = 500, overlap: int = 0) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else P.chunk_text(t, target, overlap))

    return _arrow("array<string>", run)(text)


def sections(text) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else P.split_sections(t))

    return _arrow("array<string>", run)(text)


# --- HTML --------------------------------------------------------------------------------------------------

# Elements whose content is no text.
NO_TEXT = ("script", "style", "nav", "header", "footer", "aside")


def html_to_text(page: Column) -> Column:
    """Plain text with light marks for headings, emphasis and code; numeric entities are decoded afterwards."""
    text = page
    for tag in NO_TEXT:
        text = F.regexp_replace(text, rf"(?is)<{tag}.*?</{tag}>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{level}[^>]*>\s*(.*?)\s*</h{level}>", "\n\n" + "#" * level + " $1\n")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|li|tr|blockquote|pre|article|section)[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?i)<hr[^>]*>", "\n---\n")
    text = F.regexp_replace(text, r"(?is)<(strong|b)[^>]*>(.*?)</\1>", "**$2**")
    text = F.regexp_replace(text, r"(?is)<(em|i)[^>]*>(.*?)</\1>", "*$2*")
    text = F.regexp_replace(text, r"(?is)<code[^>]*>(.*?)</code>", "`$1`")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " ")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def decode_entities(text) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else P.decode_numeric(t))

    return _arrow("string", run)(text)


def page_title(page: Column) -> Column:
    found = lambda p, g=1: F.nullif(F.trim(F.regexp_extract(page, ascii_bounds(p), g)), F.lit(""))
    heading = F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))
    return F.coalesce(
        found(r"""(?i)<meta\s+property=["']og:title["']\s+content=["']([^"']+)["']"""), found(r"(?is)<title[^>]*>(.*?)</title>"), F.nullif(heading, F.lit(""))
    )


def page_description(page: Column) -> Column:
    found = lambda kind: F.nullif(F.trim(F.regexp_extract(page, rf"""(?i)<meta\s+{kind}["']\s+content=["']([^"']+)["']""", 1)), F.lit(""))
    return F.coalesce(found("""property=["']og:description"""), found("""name=["']description"""))


def normal_url(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slash."""
    flat = F.regexp_replace(url, r"#.*$", "")
    flat = F.regexp_replace(flat, r"([?&])(?:utm_[a-z]+|ref)=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"&{2,}", "&"), r"\?&", "?"), r"[?&/]+$", "")


# --- entities and facts ------------------------------------------------------------------------------------

_NAME, _SOME = r"([A-Za-z][\w.-]*)", r"([A-Za-z][\w.-]*(?:\s+[\w.-]+){0,2})"
_PATH = r"([A-Za-z]:[/\\][^\s,)]+|/[^\s,)]+)"
# Predicate, confidence, subject group, object group, pattern.
FACT_PATTERNS = (
    ("port", 0.9, 1, 2, rf"(?i)\b{_NAME}\s+(?:runs\s+)?on\s+port\s+(\d+)"),
    ("uses", 0.8, 1, 2, rf"(?i)\b{_NAME}\s+(?:uses|built\s+with|powered\s+by)\s+{_SOME}"),
    ("replaced", 0.8, 1, 2, rf"(?i)\b{_NAME}\s+replaced\s+{_NAME}"),
    ("replaced", 0.8, 2, 1, rf"(?i)\bswitched\s+from\s+{_NAME}\s+to\s+{_NAME}"),
    ("path", 0.85, 1, 2, rf"(?i)\b{_NAME}\s+(?:at\s+path|path[:\s]+|data\s+dir[:\s]+)\s*{_PATH}"),
    ("default", 0.75, 1, 2, rf"(?i)\b{_NAME}\s+defaults?\s+to\s+(\S+)"),
    ("version", 0.85, 1, 2, rf"(?i)\b{_NAME}\s+(?:version\s+|v)(\d+(?:\.\d+)*(?:-[\w.]+)?)"),
    ("is", 0.7, 1, 2, r"(?m)\b([A-Z][\w.-]*)\s+is\s+(?:a|an)\s+([a-zA-Z][\w\s-]{2,30}?)(?:\.|,|;|\s*$)"),
    ("config", 0.8, 1, 2, rf"(?i)\b{_NAME}\s+(?:configured|set)\s+to\s+(\S+(?:\s+\S+){{0,3}})"),
    ("depends_on", 0.8, 1, 2, rf"(?i)\b{_NAME}\s+(?:depends\s+on|requires)\s+{_SOME}"),
    ("located_at", 0.85, 1, 2, rf"(?i)\b{_NAME}\s+(?:located\s+at|lives?\s+in|installed\s+(?:at|in))\s+{_PATH}"),
    ("runs_as", 0.8, 1, 2, rf"(?i)\b{_NAME}\s+(?:runs\s+as|started\s+with|launched\s+(?:as|with))\s+{_SOME}"),
)


def extract_spo(content: Column) -> Column:
    """Facts as an array of (subject, predicate, object, confidence), each triple once."""
    clean = {"path": r"[/\\]+$", "located_at": r"[/\\]+$", "config": r"[.,;]+$"}

    def fact(predicate, confidence, s, o, pattern):
        def run(m: Column) -> Column:
            value = F.trim(F.regexp_replace(F.regexp_extract(m, ascii_bounds(pattern), o), ascii_bounds(clean.get(predicate, r"^\b$")), ""))
            return F.struct(F.regexp_extract(m, ascii_bounds(pattern), s).alias("subject"), F.lit(predicate).alias("predicate"), value.alias("object"), F.lit(confidence).alias("confidence"))

        return run

    found = []
    for given in FACT_PATTERNS:
        facts = F.transform(F.regexp_extract_all(content, F.lit(ascii_bounds(given[-1])), F.lit(0)), fact(*given))
        if given[0] == "is":
            facts = F.filter(facts, lambda f: F.size(F.split(f["object"], r"\s+")) <= 5)
        found.append(facts)
    every = F.concat(*found)
    key = lambda f: F.lower(F.concat_ws("|", f["subject"], f["predicate"], f["object"]))
    once = lambda rows: F.transform(F.array_distinct(F.transform(rows, key)), lambda k: F.get(F.filter(rows, lambda f: key(f) == k), F.lit(0)))
    return F.get(F.transform(F.array(every), once), F.lit(0))


# --- intents and times -------------------------------------------------------------------------------------


def intent(text: Column) -> Column:
    """store, forget, update, context or search, by the words an input begins with or holds."""
    low = F.lower(text)
    return (
        F.when(low.rlike(ascii_bounds(r"^(remember|store|save|record|note|log)\b")) | low.rlike(ascii_bounds(r"\b(remember that|note that|save this|store this)\b")), "store")
        .when(low.rlike(ascii_bounds(r"^(forget|delete|remove|deactivate)\b")), "forget").when(low.rlike(ascii_bounds(r"^(update|change|modify|correct)\b")), "update")
        .when(low.rlike(ascii_bounds(r"^(what do (i|we|you) know about|context|background|brief me|catch me up|overview)\b")), "context").otherwise("search")
    )


def payload(text: Column) -> Column:
    """What is to be stored or sought, without the words of command."""
    bare = F.regexp_replace(text, r"(?i)^(remember|store|save|record|note|log|forget|delete|remove|search|find|look up|recall|what do (i|we|you) know about)\s+", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(bare, r"(?i)^that\s+", "")), F.lit("")), text)


# Events whose mention makes a near time an expiry, and the days of the week.
EVENTS = r"\b(meeting|deadline|appointment|call|exam|interview|due|submit|deploy|release|launch|demo|standup|review|presentation)\b"
WEEK = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
UNIT_HOURS = {"hour": 1, "day": 24, "week": 168, "month": 720}


def expiry(content: Column, as_of: Column) -> Column:
    """When a text that speaks of a near event stops being of use; null if it doesn't."""
    low = F.lower(content)
    event = low.rlike(ascii_bounds(EVENTS))
    later = lambda days: as_of + F.make_dt_interval(F.lit(days) if isinstance(days, int) else days)
    given = r"\bin\s+(\d+)\s+(day|hour|week|month)s?\b"
    hours = F.create_map(*[F.lit(x) for p in UNIT_HOURS.items() for x in p])[F.regexp_extract(low, ascii_bounds(given), 2)]
    # Counts that no date can hold are left out.
    amount = F.regexp_extract(low, ascii_bounds(given), 1).try_cast("long")
    span = F.when((amount > 0) & (amount * hours < 10**7), as_of + F.make_dt_interval(F.lit(0), (amount * hours).cast("int")))
    named = F.regexp_extract(low, ascii_bounds(rf"\b(?:by|on|next)\s+({'|'.join(WEEK[1:] + WEEK[:1])})\b"), 1)
    wait = F.array_position(F.array(*[F.lit(d) for d in WEEK]), named).cast("int") - F.dayofweek(as_of)
    day = F.when(named != "", later(F.when(wait <= 0, wait + 7).otherwise(wait) + 1))
    return (
        F.when(span.isNotNull(), span).when(low.rlike(ascii_bounds(r"\btomorrow\b")), later(2)).when(event & low.rlike(ascii_bounds(r"\btoday\b|\btonight\b")), later(1))
        .when(event & low.rlike(ascii_bounds(r"\b(next|this)\s+week\b")), later(8)).when(event & low.rlike(ascii_bounds(r"\b(next|this)\s+month\b")), later(35)).otherwise(day)
    )


def time_hint(query: Column, as_of: Column) -> Column:
    """(after, before) of a time phrase in a query; null without one. Weeks start on Sunday, all times are UTC."""
    day = F.date_trunc("day", as_of)
    one = F.expr("INTERVAL 1 DAY")
    week = F.date_trunc("week", as_of + one) - one
    month = F.date_trunc("month", as_of)
    low = F.lower(query)
    span = lambda a, b: F.struct(a.alias("after"), b.alias("before"))
    n = F.nullif(F.regexp_extract(low, ascii_bounds(r"\b(?:last|past)\s+(\d+)\s+days?\b"), 1), F.lit("")).cast("int")
    return (
        F.when(n.isNotNull(), span(as_of - F.make_dt_interval(n), as_of))
        .when(low.rlike(ascii_bounds(r"\byesterday\b")), span(day - one, day)).when(low.rlike(ascii_bounds(r"\btoday\b")), span(day, as_of))
        .when(low.rlike(ascii_bounds(r"\blast week\b")), span(week - F.expr("INTERVAL 7 DAYS"), week)).when(low.rlike(ascii_bounds(r"\bthis week\b")), span(week, as_of))
        .when(low.rlike(ascii_bounds(r"\blast month\b")), span(F.add_months(month, -1).cast("timestamp"), month)).when(low.rlike(ascii_bounds(r"\bthis month\b")), span(month, as_of))
        .when(low.rlike(ascii_bounds(r"\brecent(ly)?\b")), span(as_of - F.expr("INTERVAL 7 DAYS"), as_of))
    )
