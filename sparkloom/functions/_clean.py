"""Line by line cleaning of pages and linking of one line, in plain Python for Arrow batches."""

from __future__ import annotations

import re

# Lines of type definitions and schemas (compared without case, but for the first).
DEFINITIONS = (
    r"^(?-i:[A-Z])\w+ = ",
    r"^[a-z_\d]+:\s*(string|number|boolean|array|object|integer|optional)\b",
    r"^[a-z_\d]+:\s*(array of\s+)?[A-Z]\w+(\s*\{[^}]*\})?(\s+or\s+)?",
    r"^[a-z_\d]+:\s*[A-Z][A-Za-z]+$",
    r'^[a-z_\d]+:\s*"[^"]*"(\s+or\s+"[^"]*")+',
    r'^[a-z_\d]+:\s*"[^"]*"$',
    r"^(Accepts|This may be) one (of )?the following",
    r'^"[a-z0-9_/+.-]+"$',
    r"^`[^`]+`:\s*\d+\s*(minute|hour|second|ms|day)",
    r'^Defaults to [`"]',
    r"^(POST|GET|PUT|DELETE|PATCH)/\w",
)
# Furniture of web pages, whatever the length of the line (compared without case).
FURNITURE = (
    r"^(Loading\.\.\.|Copy page|Skip to content|Table of Contents|API Reference|On this page)$",
    r"^(Previous|Next|Was this helpful\??|Edit this page|Share this|Share \d+|Tweet \d+)$",
    r"^Source:\s*https?://",
    r"^Manage Cookie Consent",
    r"^(Functional|Preferences|Statistics|Marketing)\s+(Functional|Preferences|Statistics|Marketing)?",
    r"^(Accept|Deny|View preferences|Save preferences|Manage options|Manage services|Read more about)",
    r"^\{(title|email|url|required)\}",
    r"^(Written by|Trusted by|Last Updated|Updated|Forex trader)\s",
)
# Furniture of lines shorter than a length.
SHORT_FURNITURE = ((r"Expand\s*Collapse", 40), (r"cookie|consent|marketing|advertising", 100))
# Further lines that go from reference pages, as pattern, length below which it holds, and with or without case.
REFERENCE_NOISE = (
    (r"^[A-Z][a-z]+ [A-Z][a-z]+$", 40, 0), (r"^\d+k?\s+(monthly|weekly|daily)\s+\w+$", None, re.I), (r"^The number of \w+ tokens", 80, re.I),
)

_definition = re.compile("|".join(f"(?:{p})" for p in DEFINITIONS), re.I)
_furniture = re.compile("|".join(f"(?:{p})" for p in FURNITURE), re.I)
_short = [(re.compile(p, re.I), n) for p, n in SHORT_FURNITURE]
_noise = [(re.compile(p, flags), n) for p, n, flags in REFERENCE_NOISE]
_word = re.compile(r"^[a-z_]+$", re.I)
_more = re.compile(r"^\d+ more$")


def _holds(rules, line: str) -> bool:
    return any((n is None or len(line) < n) and p.search(line) for p, n in rules)


def clean_lines(text: str, aggressive: bool) -> str:
    kept: list[str] = []
    seen: set[str] = set()
    code, run = False, 0  # run: definitions and bare words in a row
    for line in text.split("\n"):
        t = line.strip()
        if t.startswith("```") or code:
            if t.startswith("```"):
                code, run = not code, 0
            kept.append(line)
            continue
        if (not t and kept and not kept[-1].strip()) or _furniture.search(t) or _holds(_short, t):
            continue
        if aggressive:
            if _definition.search(t):
                run += 1
                continue
            if _more.search(t):
                continue
            run = run + 1 if len(t) < 30 and _word.search(t) else 0
            if run > 2 or _holds(_noise, t):
                continue
        key = re.sub(r"\s+", " ", t.lower())
        keys = [key] if len(t) > 20 else []
        keys += [re.sub(r"^#+ ?", "", key)] if t.startswith("#") else []
        fresh = not any(k in seen for k in keys)
        seen.update(keys)
        if fresh:
            kept.append(line)
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(kept)).strip()


def link_line(line: str, names, links) -> str:
    """A line in which the first mention of each name outside of links becomes a link."""
    for name, link in zip(names, links, strict=True):
        found = re.search(rf"(?<!\[\[)(?<!\|)\b{re.escape(name)}\b(?![\]|])", line, re.I)
        if found:
            line = line[: found.start()] + link + line[found.end():]
    return line
