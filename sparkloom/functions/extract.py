"""Entities, relations, specifics and topics of a text, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._regex import ascii_bounds

# Technologies found whatever their case, and how some of them are written.
TECHNOLOGIES = (
    "javascript", "typescript", "python", "java", "c++", "c#", "php", "kotlin", "scala", "elixir", "haskell", "lua", "react", "vue", "angular", "svelte", "next.js", "nextjs", "nuxt", "node.js", "nodejs",
    "deno", "hono", "fastify", "django", "laravel", "postgres", "postgresql", "mysql", "sqlite", "mongodb", "redis", "dynamodb", "docker", "kubernetes", "terraform", "aws", "gcp", "azure", "vercel",
    "netlify", "git", "github", "gitlab", "linux", "windows", "macos", "graphql", "grpc", "websocket", "http", "tailwind", "css", "html", "webpack", "vite", "esbuild", "rollup", "claude", "gpt", "llm",
    "langchain", "figma", "storybook", "jest", "vitest", "playwright", "cypress", "mocha", "pnpm", "npm", "yarn", "tauri", "electron", "react native",
)
DISPLAY = {
    "javascript": "JavaScript", "typescript": "TypeScript", "python": "Python", "java": "Java", "c++": "C++", "c#": "C#", "php": "PHP", "kotlin": "Kotlin", "react": "React", "vue": "Vue",
    "angular": "Angular", "svelte": "Svelte", "next.js": "Next.js", "nextjs": "Next.js", "node.js": "Node.js", "nodejs": "Node.js", "hono": "Hono", "fastify": "Fastify", "django": "Django",
    "docker": "Docker", "kubernetes": "Kubernetes", "terraform": "Terraform", "graphql": "GraphQL", "tailwind": "Tailwind", "css": "CSS", "html": "HTML", "claude": "Claude", "gpt": "GPT", "llm": "LLM",
    "tauri": "Tauri", "electron": "Electron", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mysql": "MySQL", "sqlite": "SQLite", "mongodb": "MongoDB", "redis": "Redis", "github": "GitHub",
    "gitlab": "GitLab", "git": "Git", "playwright": "Playwright", "vitest": "Vitest", "jest": "Jest", "vite": "Vite", "webpack": "webpack", "pnpm": "pnpm",
}
# Technologies that are common words unless written so.
CASED = ("Go", "Rust", "Spring", "Express", "Flask", "Remix", "Bun", "Phoenix", "Rails", "Swift", "Ruby", "Sketch", "Cargo", "Pip", "Brew", "Sass", "Expo", "REST")
# Endings and names of organizations.
ORG_ENDINGS = "Inc|Corp|LLC|Ltd|Co|Foundation|Labs|Studio|Solutions|Group|Technologies|Tech|Systems|Software"
ORGS = (
    "Google|Microsoft|Apple|Amazon|Meta|Netflix|Stripe|Shopify|Cloudflare|GitHub|GitLab|Mozilla|Canonical|Red Hat|IBM|Oracle|Intel|NVIDIA|AMD|Tesla|SpaceX|OpenAI|Anthropic|Mistral|Hugging Face|"
    r"Databricks|Snowflake|Confluent|HashiCorp|Vercel|Supabase|PlanetScale|Neon|Fly\.io|Railway|Render"
)
# Words before or at the start of a phrase that make it no organization.
VERBS = ("building", "using", "deploying", "creating", "running", "testing", "developing", "launching", "shipping", "maintaining", "designing")
NO_ORG_START = (
    "added", "created", "built", "used", "found", "updated", "removed", "deployed", "launched", "shipped", "released", "applied", "called", "defined", "enabled", "extended", "fixed", "implemented",
    "improved", "installed", "loaded", "managed", "merged", "moved", "named", "opened", "parsed", "passed", "provided", "pushed", "rendered", "resolved", "returned", "selected", "started", "stored",
    "triggered", "my", "our", "your", "the", "a", "an", "this", "that", "its", "new", "old", "first", "last", "next", "other", "same", "each", "every", "many", "some", "any", "all", "most", "own",
)
# Capitalised words that are no names of persons.
NO_PERSON = (
    "neural", "visual", "digital", "virtual", "global", "active", "open", "native", "modern", "quick", "smart", "hybrid", "remote", "custom", "simple", "dynamic", "static", "atomic", "binary", "linear",
    "basic", "direct", "local", "final", "total", "super", "auto", "internal", "external", "primary", "secondary", "added", "agent", "alpha", "api", "automated", "bitcoin", "bot", "browser", "built",
    "chakra", "claw", "clerk", "code", "concurrent", "created", "creates", "database", "discovery", "fira", "from", "holder", "implementation", "isometric", "memory", "promise", "rendering", "schema",
    "solana", "token", "trade", "weak", "worker", "action", "all", "applied", "auth", "authentication", "autonomy", "base", "check", "codebase", "config", "configuration", "content", "count", "creation",
    "current", "data", "default", "detail", "distribution", "entry", "error", "event", "extension", "fetch", "group", "handler", "horizon", "hive", "import", "input", "interface", "item", "list",
    "manager", "method", "module", "node", "object", "other", "output", "page", "panel", "query", "request", "response", "result", "route", "server", "service", "session", "source", "state", "status",
    "storage", "store", "stream", "table", "target", "template", "test", "tick", "timer", "trigger", "type", "update", "value", "view", "world",
)
# Words that are no names of projects.
NO_PROJECT = (
    "status", "update", "version", "config", "settings", "code", "data", "apps", "tools", "files", "docs", "tests", "build", "plan", "list", "info", "notes", "log", "report", "overview", "details",
    "management", "structure", "trade", "design", "feature", "change", "system", "model", "interface", "function", "process", "service", "component", "module", "pattern", "logic", "support", "issue",
    "task", "format", "method", "page", "section", "part", "area", "layer", "flow", "pipeline", "handler", "worker", "manager", "controller", "engine", "framework",
)
# Quoted words that are no concepts, and words that don't begin one.
NO_CONCEPT = (
    "person", "organization", "technology", "project", "concept", "text", "note", "conversation", "summary", "api", "cli", "web", "nul", "null", "continue", "module", "icon", "source", "content", "type",
    "name", "value", "status", "error", "success", "pending", "active", "default", "custom", "manual", "auto", "none", "other", "true", "false", "yes", "data", "info", "test", "debug", "max", "min",
    "tags", "total", "optional", "required", "operational", "available", "ready", "complete", "failed",
)
NO_CONCEPT_START = (
    "the", "a", "an", "this", "that", "these", "those", "my", "your", "our", "his", "her", "its", "their", "no", "not", "store", "search", "find", "get", "set", "add", "remove", "delete", "update",
    "create", "load", "save", "fetch", "check", "run", "use", "list", "show", "browse", "view", "open", "close", "start", "stop", "enable", "disable", "configure", "install", "build", "deploy", "apply",
    "filter", "select", "sort", "group", "import", "export",
)
# Concepts of one domain.
CONCEPTS = (
    "machine learning|deep learning|artificial intelligence|neural network|natural language processing|computer vision|reinforcement learning|transfer learning|federated learning|RAG|"
    "retrieval augmented generation|knowledge graph|vector database|embedding|fine-tuning|prompt engineering|agentic AI|multi-agent|chain of thought|few-shot|zero-shot|tokenization|"
    "attention mechanism|transformer architecture"
)
_PERSON = r"\b(?:by|from|with|author|creator|founder|CEO|CTO|met|told|asked|said|name is|called)\s+([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]{2,})\b"
_PROJECT = r"\b(?:[Ww]orking on|[Bb]uilding|[Pp]roject|[Ll]aunched|[Ss]hipped|[Dd]eployed|[Rr]eleased|[Cc]reated|[Dd]eveloping|[Mm]aintained)\s+([A-Z][a-zA-Z0-9]+(?:[-_.][a-zA-Z0-9]+)*)"
_PROJECT_BEFORE, _PROJECT_AFTER = r"\b([A-Z][a-zA-Z0-9]+)\s+project\b", r"\bprojects[:\s]+([A-Z][a-zA-Z0-9]+)"
_FILE = r"\.(ts|tsx|js|jsx|mjs|cjs|css|html|json|md|yaml|yml|toml|sql|sh|py|rs|go)$"


def _list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _escaped(words) -> str:
    return "|".join("".join(f"\\{c}" if c in ".*+?^${}()|[]\\" else c for c in w) for w in words)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_bounds(pattern)), F.lit(group))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a lambda that names it again would work it out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_technology(name: Column) -> Column:
    # Cased names count wherever they stand as a word of their own.
    return F.lower(name).isin(*TECHNOLOGIES) | (F.lower(name).isin(*[c.lower() for c in CASED]) & name.isin(*CASED))


def _technologies(text: Column) -> Column:
    # A name inside a longer one is looked for by itself.
    inner = "react native"
    found = F.concat(_all(text, rf"(?i)\b({_escaped([t for t in TECHNOLOGIES if t != inner])})\b"), _all(text, rf"(?i)\b({inner})\b"))
    shown = F.create_map(*[F.lit(x) for p in DISPLAY.items() for x in p])

    def named(found: Column) -> Column:
        listed = F.filter(_list(TECHNOLOGIES), lambda t: F.exists(found, lambda m: F.lower(m) == t))
        return F.transform(listed, lambda t: F.coalesce(shown[t], F.get(F.filter(found, lambda m: F.lower(m) == t), F.lit(0))))

    names = let(found, named)
    cased = F.array_intersect(_list(CASED), _all(text, rf"\b({_escaped(CASED)})\b"))
    return F.concat(names, cased)


def _organizations(text: Column) -> Column:
    verb = "|".join(VERBS)
    pattern = rf"(?:(?<!\S)({verb})\s+)?\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+({ORG_ENDINGS})\b"
    part = lambda m, g: F.regexp_extract(m, rf"^(?:({verb})\s+)?([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+({ORG_ENDINGS})$", g)
    kept = F.filter(_all(text, pattern, 0), lambda m: (part(m, 1) == "") & ~F.lower(F.regexp_extract(m, r"^(\S+)", 1)).isin(*NO_ORG_START))
    return F.concat(F.transform(kept, lambda m: F.concat(part(m, 2), F.lit(" "), part(m, 3))), _all(text, rf"\b({ORGS})\b"))


def _persons(text: Column) -> Column:
    clear = lambda n: ~F.exists(F.split(n, r"\s+"), lambda p: _is_technology(p) | F.lower(p).isin(*NO_PERSON))
    return F.filter(_all(text, _PERSON), clear)


def _projects(text: Column) -> Column:
    plain = lambda n: ~_is_technology(n) & ~F.lower(n).isin(*NO_PROJECT) & (F.length(n) > 2)
    named = F.filter(_all(text, _PROJECT), lambda n: plain(n) & ~F.lower(n).rlike("-(ready|based|assisted|driven|oriented)$") & ~n.rlike(ascii_bounds(_FILE)))
    return F.concat(named, F.filter(F.concat(_all(text, _PROJECT_BEFORE), _all(text, _PROJECT_AFTER)), plain))


def _quoted(text: Column) -> Column:
    def good(name: Column) -> Column:
        words = F.split(name, r"\s+")
        first = F.lower(F.get(words, F.lit(0)))
        several = (
            (F.size(words) <= 3) & name.rlike("^[A-Z]") & ~name.rlike(r"^[A-Z\s]+$") & ~name.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+$")
            & ~F.lower(name).isin(*NO_CONCEPT) & ~first.isin(*NO_CONCEPT, *NO_ORG_START, *NO_CONCEPT_START)
        )
        return ~_is_technology(name) & F.when(F.size(words) == 1, name.rlike("^[A-Z]{3,}$")).otherwise(several)

    return F.filter(F.transform(_all(text, r'"([A-Za-z][A-Za-z\s]{2,30})"'), F.trim), good)


def extract_entities(text: Column) -> Column:
    """Entities as an array of (name, type, confidence), each lower-cased name once at its surest, the surest first.

    Kinds that are found with less than 0.85 confidence are given as concepts.
    """
    kinds = (
        ("technology", 0.9, _technologies(text)), ("organization", 0.85, _organizations(text)), ("concept", 0.75, _persons(text)), ("concept", 0.65, _projects(text)),
        ("concept", 0.4, _quoted(text)), ("concept", 0.8, _all(text, rf"(?i)\b({CONCEPTS})\b")),
    )
    entity = lambda kind, sure: lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    every = F.concat(*[F.transform(names, entity(kind, sure)) for kind, sure, names in kinds])
    # Let: the concatenation is made once, then read many times.
    def merged(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda e: F.lower(e["name"])))
        best = lambda k: F.array_max(F.transform(F.filter(found, lambda e: F.lower(e["name"]) == k), lambda e: e["confidence"]))
        pick = lambda k, i: F.struct((-best(k)).alias("o"), i.alias("i"), F.get(F.filter(found, lambda e: (F.lower(e["name"]) == k) & (e["confidence"] == best(k))), F.lit(0)).alias("e"))
        return F.transform(F.sort_array(F.transform(keys, pick)), lambda x: x["e"])

    return F.get(F.transform(F.array(every), merged), F.lit(0))


# The phrases that state a relation between two names.
RELATIONS = (
    ("uses", "uses|using|use"), ("uses", r"built\s+(?:with|on|using)"), ("uses", r"depends\s+on|relies\s+on"), ("works_at", r"works\s+at|joined|works\s+for"),
    ("part_of", r"is\s+part\s+of|belongs\s+to"), ("created", "created|built|authored|developed|wrote"), ("replaces", "replaces|supersedes|replaced"),
)


def extract_relations(text: Column, entities: Column) -> Column:
    """Relations between two of the given entities, as an array of (source, target, relationship, confidence, context), each once.

    A phrase begins at its line's start or after the phrase before it, so that a line is read once.
    """
    def end(raw: Column) -> Column:
        low = F.lower(F.trim(raw))
        same = F.filter(entities, lambda e: F.lower(e["name"]) == low)
        inside = F.filter(entities, lambda e: F.contains(low, F.lower(e["name"])))
        return F.coalesce(F.get(same, F.lit(0)), F.get(inside, F.lit(0)))["name"]

    def stated(kind: str, verb: str) -> Column:
        body = rf"\b(.+?)\s+(?:{verb})\s+(.+?)(?:\s+(?:for|to|in|as|with)\s+([^.,]+))?(?:\.|,|\z)"
        phrases = _all(text, rf"(?i)(?:\G|(?<=[\n\r]))[^\w\n\r]*{body}", 0)
        phrases = F.when(text.rlike(rf"(?i)\s(?:{verb})\s"), phrases).otherwise(F.array().cast("array<string>"))
        part = lambda m, g: F.regexp_extract(m, rf"(?i)^[^\w\n\r]*{body}", g)
        made = F.transform(phrases, lambda m: F.struct(
            end(part(m, 1)).alias("source"), end(part(m, 2)).alias("target"), F.lit(kind).alias("relationship"), F.lit(0.7).alias("confidence"), F.nullif(F.trim(part(m, 3)), F.lit("")).alias("context")
        ))
        return F.filter(made, lambda r: r["source"].isNotNull() & r["target"].isNotNull() & (r["source"] != r["target"]))

    found = [stated(*r) for r in RELATIONS]
    every = F.concat(*found)
    key = lambda r: F.lower(F.concat_ws("|", r["source"], r["relationship"], r["target"]))

    def once(rows: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(rows, key)), lambda k: F.get(F.filter(rows, lambda r: key(r) == k), F.lit(0)))

    some = F.get(F.transform(F.array(every), once), F.lit(0))
    return F.when(F.size(entities) >= 2, some).otherwise(F.filter(every, lambda r: F.lit(False)))


# Patterns of details that can be looked up, and of sentences that state a key fact.
SPECIFICS = (r"(?i)(?:[A-Z]:)?(?:/[\w.-]+){2,}(?:\.\w+)?", r"v?\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?", r"\b[a-z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]*)+\b", r"`[^`]+`")
KEY_FACTS = (
    r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", r"\b\d+(\.\d+)?%", r"\$[\d,.]+", r"(?i)\b\d+(\.\d+)?\s*(ms|seconds?|minutes?|hours?|days?|GB|MB|KB|k|M)\b", r"(?i)\b(decided|decision|chose|chosen|selected|resolved)\b",
    r"(?i)\b(architecture|design|pattern|approach|strategy|schema|migration)\b", r"(?i)\b(bug|fix|error|issue|problem|broken|resolved)\b", r"(?i)\b(added|removed|created|deleted|updated|changed|migrated)\b",
)


def specifics(text: Column) -> Column:
    """Paths, versions, code names and quoted code of a text, each once."""
    return F.array_distinct(F.concat(*[_all(text, p, 0) for p in SPECIFICS]))


def states_fact(sentence: Column) -> Column:
    """Whether a sentence states a key fact: a date, a measure, a decision, a change."""
    return reduce(lambda a, b: a | b, [sentence.rlike(ascii_bounds(p)) for p in KEY_FACTS])


def fact_sentences(text: Column) -> Column:
    """Sentences of a text that state a key fact: a date, a measure, a decision, a change."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]\n|[.!?]\s"), F.trim), lambda s: F.length(s) > 10)
    return F.filter(parts, states_fact)


# Topics of a conversation and the words that show them.
TOPICS = {
    "coding": ("function", "variable", "class ", "import ", "export ", "const ", "async ", "await "), "debugging": ("error", "bug", "fix", "stack trace", "exception", "crash"),
    "architecture": ("architecture", "design pattern", "microservice", "monolith", "api design"), "database": ("database", "sql", "query", "migration", "schema", "postgres", "sqlite", "mongodb"),
    "devops": ("docker", "kubernetes", "deploy", "ci/cd", "pipeline", "terraform"), "frontend": ("react", "css", "component", "ui ", "ux ", "tailwind", "html"),
    "backend": ("server", "endpoint", "middleware", "route", "api"), "testing": ("test", "jest", "vitest", "coverage", "assertion", "mock"),
    "ai": ("llm", "claude", "gpt", "prompt", "embedding", "model", "anthropic", "openai"), "security": ("auth", "token", "password", "encrypt", "vulnerability", "cors"),
    "performance": ("optimize", "performance", "latency", "cache", "benchmark"),
}


def topics(text: Column, most: int = 5) -> Column:
    low = F.lower(text)
    shown = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(topic)) for topic, words in TOPICS.items()]
    return F.slice(F.array_compact(F.array(*shown)), 1, most)


def weighted_words(text: Column, weights: Column) -> Column:
    """Sum of the weights (a map of lower-cased words) of the words that a text holds."""
    low = F.lower(text)
    return F.aggregate(F.map_entries(weights), F.lit(0).cast("long"), lambda a, e: a + F.when(F.contains(low, e["key"]), e["value"]).otherwise(0).cast("long"))


# The halls of a record, with the tags and the words that lead there, the first that fits.
HALLS = {
    "facts": (("decision", "architecture", "config", "schema"), ("decided", "chose", "switched to", "migrated")),
    "events": (("session-summary", "milestone", "deployment", "release"), ("deployed", "shipped", "released", "completed")),
    "discoveries": (("discovery", "research", "proactive-insight", "investigation"), ("found that", "discovered", "learned", "realized")),
    "techniques": (("technique", "skill", "learning", "how-to", "procedural"), ("skill:", "trigger:", "procedure:")),
    "preferences": (("preference", "style", "convention"), ("prefer", "always use", "avoid", "convention")),
}


def hall_of(tags: Column, content: Column) -> Column:
    low, own = F.lower(content), F.transform(tags, F.lower)
    out = F
    for hall, (names, words) in HALLS.items():
        fits = F.arrays_overlap(own, _list(names)) | reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        out = out.when(F.coalesce(fits, F.lit(False)), hall)
    return out.otherwise("notes")
