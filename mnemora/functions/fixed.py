"""Fixed values that results depend on: word lists, patterns, weights and ages."""

from __future__ import annotations

# fixed values: families of feedback, the first that matches names the text
FEEDBACK_FAMILIES = (
    ("correction", r"no|not|actually|instead|wait|stop"),
    ("instruction", r"remember|don'?t forget|keep in mind"),
    ("preference", r"I prefer|always use|never use|we (?:always|never)"),
    ("rejection", r"wrong|incorrect|that'?s not|not right"),
    ("requirement", r"should (?:be|use)|need to|must"),
)
# fixed values: texts that only acknowledge
ACKNOWLEDGEMENTS = (
    r"ok|okay|thanks|thank you|cool|nice|great|got it|sure|yes|yep|no problem|"
    r"make sense|sounds good|perfect|awesome|lol|haha|👀|👍|✅"
)
# fixed values: words of a rule
IMPERATIVES = r"do not|don'?t|always|never|must|should"
# fixed values: phrases of a page that replaces another
NEGATIONS = (
    r"instead\s+of", r"not\s+anymore", r"replaced\s+by", r"superseded?\s+by",
    r"no\s+longer", r"changed\s+from", r"migrated?\s+from", r"switched?\s+(?:from|to)",
)
# fixed values: words left out of shared ones between tasks, between titles, and of topics
TASK_STOP = ("the", "a", "an", "for", "of", "to", "in", "and", "fix", "add", "update")
TITLE_STOP = ("the", "a", "an", "for", "of", "to", "in", "and", "with", "mode", "hook")
TOPIC_STOP = ("should", "would", "could", "their", "there", "about", "after", "being")
# fixed values: lines without information
NOISE_LINES = (
    r"^\s*-\s*Trigger:\s*.*$", r"^\s*-\s*Transcript:\s*.*$", r"^\s*-\s*Project root:\s*.*$",
    r"^\s*\(no summary.*\)\s*$", r"(?i)^\s*###\s*Compact summary\s*$", r"(?i)^\s*</?(?:analysis|summary)>\s*$",
)
# fixed values: marks of text decoded with the wrong code page, and the share of a line they may have
MOJIBAKE = (
    "Ð", "Ñ", "Â", "Ã", "вЂ", "РЎ", "Рѕ", "Р°", "Рµ", "Р¶", "РЅ", "С‚", "СЂ", "С€", "С‹", "Рё", "Р»", "в†", "РїРѕ", "РЅРµ", "РЅР°",
)
MOJIBAKE_SHARE = 0.04
# fixed values: weights of a page's authority; others weigh 1
AUTHORITY = {"user": 1.35, "human": 1.35, "ai-derived": 1.0, "ai": 1.0, "web": 0.9, "inferred": 0.8, "unknown": 1.0}
# fixed values: page types, their other names, days until they are stale, and those that never are
TYPES = (
    "debugging", "pattern", "raw-source", "concept", "decision", "qa", "entity", "synthesis", "workflow", "gap",
    "skill", "rule", "project-state", "project-context", "bootstrap-context",
)
TYPE_ALIASES = {"comparison": "synthesis", "connection": "synthesis", "fact": "concept"}
STALE_DAYS = {"debugging": 60, "gap": 90, "pattern": 180, "workflow": 365, "qa": 365}
EVERGREEN = ("skill", "rule", "concept", "entity", "decision", "synthesis", "project-state", "project-context", "bootstrap-context")
# fixed values: pages that aren't curated content, those that owe no backlink (a vault may add its own), and those whose brackets aren't links
EDITORIAL = ("index.md", "log.md", "Vault Home.md", "AGENTS.md", "operating-model.md", "guardrails.md", "README.md", "state.md")
BACKLINK_EXEMPT = (
    "Ingestion Workflow.md", "Retrieval Workflow.md", "Review Workflow.md", "Vault Home.md", "index.md", "log.md",
)
LITERAL_BRACKETS = ("operating-model.md", "AGENTS.md", "log.md")
# fixed values: names and folders that search leaves out, names that the catalogue leaves out, statuses that are inactive
SEARCH_SKIP_NAMES = ("index.md", "log.md", "README.md", "state.md", "context.md")
SEARCH_SKIP_FOLDERS = ("projects", "gaps", "raw-sources")
CATALOGUE_SKIP_NAMES = ("README.md", "index.md", "log.md")
INACTIVE = ("superseded", "archived")
# fixed values: names that never get a type, and those that don't at the root
RESERVED_NAMES = ("index.md", "log.md")
CONTRACT_NAMES = ("CLAUDE.md", "README.md", "AGENTS.md", "LLM.md")
# fixed values: part of a path and the type it means, the first that a path has decides
TYPE_BY_PATH = (
    ("knowledge/notes/decisions/", "decision"), ("knowledge/notes/patterns/", "pattern"), ("knowledge/notes/debugging/", "debugging"),
    ("knowledge/notes/concepts/", "concept"), ("knowledge/notes/qa/", "qa"), ("knowledge/notes/workflows/", "workflow"),
    ("knowledge/notes/facts/", "concept"), ("knowledge/notes/entities/", "entity"), ("knowledge/notes/syntheses/", "synthesis"),
    ("knowledge/notes/comparisons/", "synthesis"), ("knowledge/notes/connections/", "synthesis"), ("knowledge/projects/", "project-state"),
    ("skills/", "skill"), ("rules/", "rule"), ("knowledge/notes/", "concept"),
)
# fixed values: types whose pages have to name sources; categories of a plan and of feedback with their types
CLAIM_TYPES = ("concept", "decision", "pattern", "debugging", "qa", "gap")
CATEGORY_TYPES = {"concepts": "concept", "decisions": "decision", "patterns": "pattern", "debugging": "debugging", "qa": "qa"}
FEEDBACK_TYPES = {
    "correction": "pattern", "instruction": "pattern", "preference": "decision", "rejection": "decision",
    "requirement": "qa", "concepts": "concept", "workflow": "workflow",
}
FEEDBACK_CATEGORY_TYPES = {"debugging": "debugging", "qa": "qa", "decisions": "decision", "concepts": "concept", "workflow": "workflow"}
# fixed values: sections of the catalogue in their order
CATALOGUE_SECTIONS = {
    "concept": "Concepts", "decision": "Decisions", "pattern": "Patterns", "debugging": "Debugging", "qa": "Q&A", "entity": "Entities",
    "synthesis": "Syntheses", "comparison": "Comparisons", "connection": "Connections", "workflow": "Workflows", "raw-source": "Raw sources",
}
# fixed values: tools whose use is recorded, those that name a file, agents in the order they are looked for
RECORDED_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit", "Bash")
FILE_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
AGENTS = ("OpenCode", "Codex", "Claude")
# fixed values: files that make a folder a project, and what they say of its tools
PROJECT_MARKERS = (
    ".claude", "CLAUDE.md", ".git", "package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "build.gradle",
    "build.gradle.kts", "Gemfile", "composer.json", ".csproj", "mix.exs",
)
STACK_MARKERS = {
    "package.json": "Node.js / JavaScript", "pyproject.toml": "Python", "requirements.txt": "Python", "Cargo.toml": "Rust", "go.mod": "Go",
    "pom.xml": "Java / Maven", "build.gradle": "Java / Gradle", "Gemfile": "Ruby", "composer.json": "PHP", "mix.exs": "Elixir",
    "docker-compose.yml": "Docker", "Dockerfile": "Docker", ".gitlab-ci.yml": "GitLab CI", "Makefile": "Make",
}
FRAMEWORKS = {"next": "Next.js", "react": "React", "vue": "Vue.js", "express": "Express", "typescript": "TypeScript"}
DULL_COMMITS = ("formatting", "merge branch", "bump version", "update .gitignore")
# fixed values: paths that an export must not hold, at its root (a vault adds its state folder) and anywhere
FORBIDDEN_ROOTS = (
    ".venv/", ".git/", ".pytest_cache/", "__pycache__/", ".obsidian/", "cache/", "logs/", "run/", "state/", "wiki/", "memory/",
    "outputs/", ".ci-lint-state/",
)
FORBIDDEN_ANYWHERE = (".obsidian/workspace.json", ".claude/settings.local.json", "gitleaks-report.json", "gitleaks-report.sarif")
# fixed values: tokens of a reply's first line with their tier, texts that say that nothing lasts, beginnings of replies that aren't one
REPLY_TIERS = {"FLUSH_MAJOR": "major", "FLUSH_MINOR": "minor", "FLUSH_OK": "ok"}
NOTHING_LASTS = ("FLUSH_OK", "NO_DURABLE_CONTENT", "(NO DURABLE CONTENT)")
NO_REPLY = ("(summary failed", '{"operations"', '{"audit"')
