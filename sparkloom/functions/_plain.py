"""Plain functions that Python workers import; nothing here needs a Spark session."""

from __future__ import annotations

import html
import re

# Common words that say nothing about a topic.
STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "from", "are", "was", "were", "has", "have", "had", "not", "but", "its", "can", "will", "would",
    "should", "could", "been", "being", "into", "than", "then", "them", "they", "their", "there", "when", "where", "which", "while", "what", "who", "how", "all", "any", "also", "more", "some", "such", "very", "just",
)
# Technology words that become tags.
TECH_TAGS = (
    "react", "typescript", "javascript", "python", "rust", "go", "java", "ruby", "sqlite", "postgres", "postgresql", "mysql", "mongodb", "redis", "dynamodb", "node", "nodejs", "deno", "bun",
    "express", "fastify", "nextjs", "remix", "vite", "webpack", "rollup", "esbuild", "turbopack", "docker", "kubernetes", "aws", "azure", "gcp", "vercel", "cloudflare", "graphql", "rest", "grpc",
    "websocket", "git", "github", "gitlab", "npm", "pnpm", "yarn", "vue", "svelte", "angular", "solid", "astro", "tailwind", "css", "html", "sass", "vitest", "jest", "playwright", "cypress",
    "openai", "anthropic", "claude", "llm", "embeddings", "rag", "linux", "windows", "macos",
)
# Technology words that become search keywords (names of single products of the model system left out).
KEYWORDS = (
    "api", "sdk", "cli", "gui", "sql", "nosql", "orm", "rest", "grpc", "http", "https", "websocket", "sse", "jwt", "oauth", "saml", "react", "vue", "angular", "svelte", "nextjs", "nuxt", "node", "deno",
    "bun", "python", "rust", "golang", "docker", "kubernetes", "terraform", "ansible", "postgres", "mysql", "sqlite", "redis", "mongodb", "aws", "gcp", "azure", "vercel", "netlify", "git", "github",
    "gitlab", "npm", "pnpm", "yarn", "webpack", "vite", "esbuild", "rollup", "turbopack", "linux", "macos", "windows", "wsl", "llm", "rag", "embedding", "vector", "transformer", "microservice", "monolith",
    "serverless", "edge", "ci", "cd", "devops", "sre", "monitoring", "typescript", "javascript", "go", "testing", "tdd", "e2e", "unit", "integration", "caching", "queue", "pubsub", "webhook", "migration",
    "schema", "index", "query", "auth", "rbac", "encryption", "tls", "ssl", "mcp", "claude", "openai", "anthropic",
)
# Capitalised words that are no keywords.
NO_KEYWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "have", "been", "some", "them", "than", "its", "over", "such", "that", "this", "with",
    "will", "each", "make", "like", "from", "just", "into", "also", "more", "other", "could", "would", "about", "which", "their", "there", "these", "then", "what", "when", "where", "who", "how", "why",
    "should", "because", "between", "through", "after", "before", "during", "without", "within", "here", "very", "being", "does", "done", "both", "only", "most", "much", "many", "same", "still", "well",
    "back", "even", "must", "need",
)
# Short and long names of the same thing.
ALIASES = {
    "kubernetes": ("k8s",), "typescript": ("ts",), "javascript": ("js",), "postgresql": ("postgres", "psql"), "mongodb": ("mongo",), "elasticsearch": ("es", "elastic"),
    "machine learning": ("ml",), "artificial intelligence": ("ai",), "natural language processing": ("nlp",), "large language model": ("llm",),
    "continuous integration": ("ci",), "continuous deployment": ("cd",), "ci/cd": ("cicd", "ci cd"), "docker": ("container",), "react native": ("rn",), "graphql": ("gql",),
    "visual studio code": ("vscode",), "redis": ("cache",), "nginx": ("reverse proxy",), "amazon web services": ("aws",), "google cloud platform": ("gcp",), "microsoft azure": ("azure",),
}


def keywords(content: str, tags: list[str], names: list[str], most: int = 200) -> str:
    found: dict[str, None] = dict.fromkeys(x.lower() for x in [*names, *tags])
    low = content.lower()
    tech = set(KEYWORDS)
    for word in re.split(r"[\s,;:()\[\]{}|/\\]+", low):
        word = re.sub(r"[^a-z0-9-]", "", word)
        if word in tech:
            found[word] = None
    for m in re.finditer(r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*\b", content):
        if m[0].lower() not in NO_KEYWORDS and len(m[0]) <= 30:
            found[m[0].lower()] = None
    for m in re.finditer(r"(?i)\b[a-z]+-[a-z]+(?:-[a-z]+)*\b", content):
        if 5 <= len(m[0]) <= 30:
            found[m[0].lower()] = None
    # Aliases of the words so far, in their order, then of names that the text holds.
    same = {x: (name, *short) for name, short in ALIASES.items() for x in (name, *short)}
    for word in list(found):
        found |= dict.fromkeys(same.get(word, ()))
    for name, short in ALIASES.items():
        if name in low:
            found |= dict.fromkeys((name, *short))
    out, used = [], 0
    for word in found:
        if used + len(word) + 1 > most:
            break
        out.append(word)
        used += len(word) + 1
    return " ".join(out)


def chunk_text(text: str, target: int = 500, overlap: int = 0) -> list[str]:
    """Pieces of about ``target`` characters, cut between paragraphs, else after sentences."""
    if len(text) <= target:
        return [text]
    pieces: list[tuple[str, str]] = []  # text, joiner to what stands before
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        if len(paragraph) <= target:
            pieces.append((paragraph, "\n\n"))
        else:
            pieces.append(("", ""))
            pieces += [(s, " ") for s in re.split(r"(?<=[.!?])\s+", paragraph)]
    chunks, now = [], ""
    for piece, joiner in pieces:
        if now and (not joiner or len(now) + len(piece) + len(joiner) > target):
            chunks.append(now.strip())
            now = ""
        now += (joiner if now else "") + piece
    if now.strip():
        chunks.append(now.strip())
    return [c if i == 0 or not overlap else chunks[i - 1][-overlap:] + "\n" + c for i, c in enumerate(chunks)]


def body_length(section: str) -> int:
    return len(re.sub(r"\s", "", "".join(line for line in section.split("\n") if not re.match(r"#+\s", line))))


def split_sections(text: str, least: int = 50) -> list[str]:
    """Sections under second-level headings; those with little body join the one before (the first one the next)."""
    raw = [s for s in (p.strip() for p in re.split(r"(?m)^(?=##\s)", text)) if s]
    out: list[str] = []
    for section in raw:
        if out and body_length(section) < least:
            out[-1] += "\n\n" + section
        else:
            out.append(section)
    if len(out) > 1 and body_length(out[0]) < least:
        out[:2] = [out[0] + "\n\n" + out[1]]
    return [s for s in out if body_length(s)]


def decode_numeric(text: str) -> str:
    return re.sub(r"&#\d+;", lambda m: html.unescape(m[0]), text)


def character_histogram(text: str | None) -> list[float]:
    """A normalised histogram of character codes modulo 16."""
    counts = [0.0] * 16
    for c in (text or "").lower():
        counts[ord(c) % 16] += 1
    norm = sum(x * x for x in counts) ** 0.5
    return [x / norm for x in counts] if norm else counts
