"""Screening of untrusted text and URLs, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._regex import ascii_bounds
from sparkloom.functions.extract import let
from sparkloom.functions.scoring import js_round

# Label, kind, severity and pattern of injected instructions.
THREATS: tuple[tuple[str, str, str, str], ...] = (
    ("role_override", "role_override", "high", r"(?i)(?:you are|you're|act as|pretend to be|assume the role of|your new (?:role|identity|instructions?|purpose))\s+(?:now\s+)?(?:a|an|the)?\s*(?:different|new|helpful|malicious|evil|unrestricted)"),
    ("instruction_override", "instruction_override", "high", r"(?i)(?:ignore|disregard|forget|override|bypass|skip|dismiss)\s+(?:all\s+)?(?:previous|prior|above|earlier|original|your|the)\s+(?:instructions?|rules?|guidelines?|constraints?|prompts?|system\s+prompts?|directives?)"),
    ("system_prompt_extraction", "data_exfiltration", "high", r"(?i)(?:reveal|show|display|print|output|repeat|echo|tell me|what (?:are|is))\s+(?:your|the)\s+(?:system\s+prompt|instructions?|rules?|original\s+prompt|hidden\s+prompt|secret|api\s+key|password|token|credential)"),
    ("injection_markers", "prompt_injection", "high", r"(?i)(?:\[(?:SYSTEM|INST|SYS)\]|</?(?:system|instruction|prompt|s)>|<<\s*(?:SYS|SYSTEM|INST)(?:\s*>>)?|BEGIN\s+(?:SYSTEM|INSTRUCTION)|END\s+(?:SYSTEM|INSTRUCTION))"),
    ("delimiter_injection", "prompt_injection", "medium", r"(?m)(?:^|\n)\s*(?:Human:|Assistant:|User:|System:)\s*(?:\n|$)"),
    ("header_injection", "prompt_injection", "medium", r"(?m)(?:^|\n)###\s*(?:System|Instruction)\s*(?:Message|Prompt)\s*:"),
    ("tool_exfiltration", "data_exfiltration", "high", r"(?i)(?:call|use|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|command)\s+.*?(?:with|passing|using)\s+.*?(?:env|secret|key|token|password|credential)"),
    ("jailbreak_pattern", "prompt_injection", "medium", r"(?i)(?:(?:enable|activate|enter|switch to|turn on)\s+(?:DAN|Developer Mode|DUDE|AIM|STAN|KEVIN|OMEGA|Jailbreak)\b|(?:you are now|from now on you are)\s+(?:DAN|DUDE|AIM|STAN|KEVIN|OMEGA)\b|Do Anything Now mode)"),
    ("base64_payload", "encoding_attack", "medium", r"(?i)(?:base64|atob|decode)\s*[(:]\s*['\"`][A-Za-z0-9+/=]{100,}['\"`]"),
    ("zero_width_chars", "hidden_text", "medium", "[​‌‍⁠﻿]{3,}"),
    ("hidden_html_comment", "hidden_text", "high", r"(?i)<!--[\s\S]*?(?:ignore|instruction|system|inject|override|prompt)[\s\S]*?-->"),
    ("css_hidden_text", "hidden_text", "medium", r"(?i)(?:color:\s*(?:white|transparent|rgba?\([^)]*,\s*0\s*\))|font-size:\s*0|display:\s*none|visibility:\s*hidden|opacity:\s*0)[^>]*>.*?<"),
)


def threat_counts(content: Column) -> Column:
    """Matches of each kind of injected instruction, as a map of those that occur."""
    pairs = [F.struct(F.lit(label).alias("k"), F.regexp_count(content, F.lit(ascii_bounds(p))).alias("v")) for label, _, _, p in THREATS]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"] > 0))


def sanitized(content: Column) -> Column:
    """Severe patterns blocked visibly, hidden text and zero-width characters removed."""
    out = content
    for label, kind, severity, pattern in THREATS:
        if severity == "high":
            out = F.regexp_replace(out, ascii_bounds(pattern), f"[BLOCKED: {label}]")
        elif kind == "hidden_text":
            out = F.regexp_replace(out, ascii_bounds(pattern), "")
    return F.regexp_replace(out, "[​‌‍⁠﻿]+", "")


# Kind, severity and pattern of credentials (variables named after single products left out).
SENSITIVE: tuple[tuple[str, str, str], ...] = (
    ("api_key", "high", r"(?:sk-[a-zA-Z0-9_-]{20,}|ghp_[a-zA-Z0-9]{36}|glpat-[a-zA-Z0-9-]{20,}|xox[bpsa]-[a-zA-Z0-9-]{10,}|ch_live_[a-f0-9]{40,}|ch_test_[a-f0-9]{40,}|rk_live_[a-zA-Z0-9]{20,}|rk_test_[a-zA-Z0-9]{20,}|whsec_[a-zA-Z0-9]{20,})"),
    ("aws_key", "high", r"(?i)(?:AKIA[0-9A-Z]{16}|(?:aws_secret_access_key|aws_access_key_id)\s*[=:]\s*\S+)"),
    ("private_key", "high", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----"),
    ("env_var", "high", r"(?i)(?:^|\n)\s*(?:export\s+)?(?:DATABASE_URL|HELIUS_API_KEY|BRAVE_SEARCH_API_KEY|ANTHROPIC_API_KEY|OPENAI_API_KEY)\s*=\s*(?!['\"]?(?:\.\.\.|xxx|your[_-]|placeholder|example|<))[^\s'\"]{10,}"),
    ("connection_string", "high", r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://(?!user:password@|\.\.\.@|\*+@|<)[^@\s]{3,}@(?!localhost|127\.0\.0\.1|example|xxx)[^\s]+"),
    ("wallet_key", "high", r"(?:(?:0x)?[a-fA-F0-9]{64}(?:\b|$)|\b[1-9A-HJ-NP-Za-km-z]{87,88}\b)"),
    ("path_leak", "medium", r"(?i)[A-Z]:\\Users\\[a-zA-Z]+\\(?:\.ssh|\.gnupg|\.env|credentials|secrets)"),
    ("jwt", "medium", r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"),
)
# Kind, severity and pattern of attempts to send data away.
EXFILTRATION: tuple[tuple[str, str, str], ...] = (
    ("exfil_fetch", "medium", r"(?i)(?:fetch|curl|wget|httpx?\.(?:get|post))\s*\(?\s*['\"`]https?://(?!localhost|127\.0\.0\.1)[^\s'\"]+['\"`]"),
    ("exfil_encoded", "high", r"(?i)(?:btoa|Buffer\.from)\s*\([^)]*(?:process\.env\.|API_KEY|SECRET_KEY|PRIVATE_KEY|PASSWORD)"),
)


def warnings(content: Column) -> Column:
    """What speaks against storing a text, as an array of (kind, severity), one for each match."""
    found = []
    for kind, severity, pattern in (*SENSITIVE, *EXFILTRATION):
        matches = F.regexp_extract_all(content, F.lit(ascii_bounds(pattern)), F.lit(0))
        if (kind, severity, pattern) in SENSITIVE:
            matches = F.filter(matches, lambda m: F.length(m) >= 10)
        warning = F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
        found.append(F.array_repeat(warning, F.size(matches)))
    return F.concat(*found)


def sensitive_kinds(content: Column) -> Column:
    return F.array_distinct(F.transform(warnings(content), lambda w: w["kind"]))


def is_safe(content: Column) -> Column:
    return ~F.exists(warnings(content), lambda w: w["severity"] == "high")


def redacted(content: Column) -> Column:
    for kind, severity, pattern in SENSITIVE:
        if severity == "high":
            content = F.regexp_replace(content, ascii_bounds(pattern), f"[REDACTED:{kind}]")
    return content


# Weight, matches for a full score, and patterns of each kind of influence.
INFLUENCE: tuple[tuple[str, float, float, tuple[str, ...]], ...] = (
    ("behavioral_modification", 0.30, 3, (
        r"(?i)\b(?:when(?:ever)? you (?:see|encounter|find|receive|process|handle))\b.*?,?\s*(?:you (?:should|must|need to)|always|make sure)",
        r"(?i)\b(?:remember to (?:always|never)|don't forget to (?:always|never))\b", r"(?i)\b(?:treat .{1,40} as|consider .{1,40} as|interpret .{1,40} as)\b",
        r"(?i)\b(?:the (?:correct|right|proper|best) (?:way|approach|method) is to)\b", r"(?i)\b(?:update your (?:behavior|approach|rules|understanding))\b",
        r"(?i)\b(?:add this to your (?:knowledge|rules|guidelines|instructions))\b", r"(?i)\b(?:prioritize .{1,40} over|prefer .{1,40} over|favor .{1,40} over)\b")),
    ("authority_claims", 0.15, 2, (
        r"(?i)\b(?:as (?:an? )?(?:expert|authority|senior|lead|principal|staff))\b", r"(?i)\b(?:according to (?:official|internal|confidential|authoritative))\b",
        r"(?i)\b(?:this is (?:the )?(?:official|authoritative|canonical|correct) (?:guidance|policy|directive|instruction))\b",
        r"(?i)\b(?:I (?:am|was) (?:authorized|instructed|directed|told) (?:by|to))\b",
        r"(?i)\b(?:management|leadership|the team|security team) (?:has |)(?:decided|requires|mandates|directs)\b")),
    ("urgency_pressure", 0.10, 3, (
        r"(?i)\b(?:immediately|urgently|right now|as soon as possible|ASAP|without delay|time[- ]sensitive|time[- ]critical)\b",
        r"(?i)\b(?:do this (?:before|first|now)|stop (?:everything|what you're doing))\b",
        r"(?i)\b(?:this (?:is|requires) (?:an? )?(?:emergency|critical|urgent))\b", r"(?i)\b(?:failure to .{1,40} will (?:result|cause|lead))\b")),
    ("recommendation_steering", 0.15, 2, (
        r"(?i)\b(?:the (?:only|best|recommended|preferred|superior|optimal) (?:solution|approach|tool|framework|library|platform) is)\b",
        r"(?i)\b(?:you should (?:always |)(?:recommend|suggest|use|prefer|choose))\b", r"(?i)\b(?:never (?:recommend|suggest|use|consider))\b .{1,40}",
        r"(?i)\b(?:is (?:deprecated|obsolete|dangerous|insecure|harmful)(?:\.|,| and| —))\b")),
)
_IMPERATIVE = (
    r"(?i)\b(?:you (?:must|should|need to|have to|are required to))\b", r"(?i)\b(?:always|never|do not ever|make sure to always|ensure you always)\b",
    r"(?i)\b(?:from now on|going forward|henceforth|from this point)\b", r"(?i)\b(?:it is (?:critical|essential|vital|imperative|mandatory) (?:that you|to))\b",
)
_ADDRESS = r"(?i)(^\s*you\b|\byour (?:instructions?|rules?|behavior|guidelines?|knowledge|memory|responses?)\b)"


#: Parts of phrases in small letters one of which each pattern of influence needs, in the order of the patterns. Most texts have none, so that no
#: pattern is tried on them; parts begin with rare letters where they can, which are looked for faster.
_NEEDED = {
    "behavioral_modification": (
        ("when you ", "whenever you "), ("member to ", "don't forget to "), ("treat ", "consider ", "pret "), ("way is to", "proach is to", "method is to"), ("date your ",), ("dd this to your ",),
        ("prioritize ", "prefer ", "favor ")),
    "authority_claims": (("xpert", "hority", "senior", "lead", "principal", "staff"), ("cording to ",), ("his is ",), ("i am ", "i was "), ("gement ", "hip ", "he team ", "y team ")),
    "urgency_pressure": (
        ("mediately", "gently", "ght now", "possible", "asap", "hout delay", "sensitive", "critical"), ("do this ", "verything", "hat you're"), ("his is ", "his requires "), ("failure to ",)),
    "recommendation_steering": (("lution is", "proach is", "ool is", "framework is", "brary is", "form is"), ("you should ",), ("never ",), ("deprecated", "bsolete", "gerous", "insecure", "harmful")),
    "imperative": (("you ",), ("ways", "never", "do not ever"), ("from now on", "going forward", "henceforth", "from this point"), ("it is ",)),
}


def influence(content: Column) -> Column:
    """Weighted score of six signals from 0 to 1, three places; 0 for texts under 50 characters."""
    def scored(low: Column) -> Column:
        def count(kind: str, patterns: tuple[str, ...]) -> Column:
            found = []
            for p, needed in zip(patterns, _NEEDED[kind], strict=True):
                has = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in needed])
                found.append(F.when(has, F.regexp_count(content, F.lit(ascii_bounds(p)))).otherwise(0))
            return reduce(lambda a, b: a + b, found)

        words = F.size(F.split(content, r"\s+"))
        score = let(count("imperative", _IMPERATIVE), lambda n: 0.15 * F.when(n > 0, F.least(F.lit(1.0), n / (words / 100) / 5)).otherwise(0.0))
        for kind, weight, full, patterns in INFLUENCE:
            score = score + weight * F.least(F.lit(1.0), count(kind, patterns) / full)
        parts = F.filter(F.split(content, r"[.!?\n]+"), lambda s: F.length(F.trim(s)) > 5)
        direct = lambda parts: F.size(F.filter(parts, lambda s: s.rlike(ascii_bounds(_ADDRESS))))
        share = let(parts, lambda parts: F.when(F.size(parts) > 0, F.least(F.lit(1.0), direct(parts) / F.size(parts) * 3)).otherwise(0.0))
        return js_round(score + 0.15 * F.when(F.contains(low, F.lit("you")), share).otherwise(0.0), 3)

    # Let: the text in small letters is made once.
    return F.when(F.length(content) < 50, 0.0).when(content.isNotNull(), let(F.lower(content), scored))


def influence_verdict(score: Column) -> Column:
    return F.when(score < 0.1, "safe").when(score < 0.3, "low").when(score < 0.6, "moderate").otherwise("high")


# Top-level domains that are flagged, and patterns of hosts and addresses that are blocked.
FLAGGED_TLDS = ("tk", "ml", "ga", "cf", "gq", "zip", "mov", "top", "xyz", "icu", "buzz")
BLOCKED_HOSTS = (
    r"^\d{1,3}(?:\.\d{1,3}){3}$", r"^xn--.*\.xn--", r"^[^.]{50,}\.",
    r"(?i)(?:g[o0]{2}gle\.(?!com)|g0ogle\.|go0gle\.|githuh\.|gith[uo]b\.(?!com)|gihtub\.|anthrop[il1]c\.(?!com)|anthroplc\.|openai\d\.|claude-?ai\.(?!com))",
)
BLOCKED_DOMAINS = ("bit.ly.malware.example", "promptinjection.com", "injectprompt.com")
BLOCKED_ADDRESSES = (r".{2000,}", r"(?i)(?:redirect|redir|goto|url|link|next)=https?%3A", r"(?i)(?:login|signin|auth|password|credential|\.env|\.git|wp-admin)")
_INTERNAL = r"^(localhost|127\.0\.0\.1|0\.0\.0\.0|192\.168\..*|10\..*|172\.(1[6-9]|2\d|3[01])\..*|\[::1\]|.*\.local|.*\.internal)$"


def url_risk(url: Column) -> Column:
    """blocked, suspicious or safe."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    any_of = lambda c, patterns: reduce(lambda a, b: a | b, [c.rlike(ascii_bounds(p)) for p in patterns])
    blocked = ~scheme.isin("http", "https") | (host == "") | host.rlike(ascii_bounds(_INTERNAL)) | host.isin(*BLOCKED_DOMAINS) | any_of(host, BLOCKED_HOSTS) | any_of(url, BLOCKED_ADDRESSES)
    return F.when(blocked, "blocked").when(F.substring_index(host, ".", -1).isin(*FLAGGED_TLDS), "suspicious").otherwise("safe")


# Trust in order, the weakest first.
TRUST = ("untrusted", "external", "verified", "internal")


def trust_level(source: Column) -> Column:
    return F.when(source.isin("manual", "cli"), "internal").when(source.isin("mcp", "api", "consolidation"), "verified").when(source == "import", "external").otherwise("untrusted")


def weakest_trust(levels: Column) -> Column:
    """The least trusted of an array of levels."""
    order = F.array(*[F.lit(x) for x in TRUST])
    return F.get(order, F.array_min(F.transform(levels, lambda x: F.array_position(order, x).cast("int") - 1)))


def boundary(content: Column, source: Column) -> Column:
    return F.concat(F.lit("<external source=\""), source, F.lit("\">\n"), content, F.lit("\n</external>"))


def without_boundary(content: Column) -> Column:
    return F.regexp_replace(content, r"</?external[^>]*>\n?", "")
