"""The vocabularies, word lists, patterns and weights that results depend on."""

# --- fixed values: enumerations -------------------------------------------------------------
OBSERVATION_TYPES = ["bugfix", "feature", "refactor", "discovery", "decision", "change"]
SCOPES = ["project", "global"]
CONCEPT_TYPES = [
    "how-it-works", "why-it-exists", "what-changed", "problem-solution", "gotcha", "pattern", "trade-off",
    "best-practice", "anti-pattern", "architecture", "security", "performance", "testing", "debugging",
    "workflow", "tooling",
    "refactoring", "api", "database", "configuration", "error-handling", "caching", "logging", "auth", "validation",
]
GLOBALIZABLE_CONCEPTS = [
    "best-practice", "pattern", "anti-pattern", "architecture", "security", "performance", "testing",
    "debugging", "workflow", "tooling",
]
RELATION_TYPES = ["causes", "fixes", "supersedes", "depends_on", "relates_to", "evolves_from"]
DETECTION_SOURCES = [
    "file_overlap", "embedding_similarity", "temporal_proximity", "narrative_mention", "concept_overlap",
    "type_progression",
]
CONFLICT_TYPES = ["superseded", "contradicts", "outdated_pattern"]
RESOLUTIONS = ["prefer_newer", "prefer_older", "manual"]
PATTERN_TYPES = ["bug", "refactor", "architecture", "anti-pattern", "best-practice"]
PATTERN_STATUSES = ["active", "deprecated", "merged"]
SESSION_STATUSES = ["active", "completed", "failed"]
SUMMARY_FIELDS = ["request", "investigated", "learned", "completed", "next_steps", "notes"]

# --- fixed values: scoring -------------------------------------------------------------------
TYPE_WEIGHTS = {
    "bugfix": 1.3, "feature": 1.2, "discovery": 1.1, "decision": 1.1, "refactor": 1.0, "change": 0.9,
}
DEFAULT_CONCEPT_WEIGHTS = {
    "security": 0.30, "gotcha": 0.25, "best-practice": 0.20, "anti-pattern": 0.20, "architecture": 0.15,
    "performance": 0.15, "error-handling": 0.15, "pattern": 0.10, "testing": 0.10, "debugging": 0.10,
    "problem-solution": 0.10, "trade-off": 0.10, "workflow": 0.05, "tooling": 0.05, "how-it-works": 0.05,
    "why-it-exists": 0.05, "what-changed": 0.05,
}
SEEDED_CONCEPT_WEIGHTS = {
    "security": 0.30, "gotcha": 0.25, "best-practice": 0.20, "anti-pattern": 0.20, "architecture": 0.15,
    "performance": 0.15, "error-handling": 0.15, "pattern": 0.10, "testing": 0.10, "debugging": 0.10,
    "workflow": 0.05, "tooling": 0.05,
}

# --- fixed values: relations -----------------------------------------------------------------
HIGH_VALUE_CONCEPTS = ["security", "architecture", "gotcha", "anti-pattern", "best-practice", "error-handling"]
# (newer type, older type, relation, confidence)
TYPE_PROGRESSIONS = [
    ("bugfix", "discovery", "fixes", 0.6),
    ("bugfix", "feature", "fixes", 0.5),
    ("bugfix", "decision", "relates_to", 0.4),
    ("feature", "discovery", "relates_to", 0.4),
    ("feature", "decision", "depends_on", 0.6),
    ("refactor", "discovery", "evolves_from", 0.5),
    ("refactor", "feature", "evolves_from", 0.5),
    ("refactor", "bugfix", "evolves_from", 0.5),
    ("decision", "discovery", "relates_to", 0.4),
    ("change", "discovery", "relates_to", 0.4),
    ("change", "decision", "relates_to", 0.4),
]
# (phrase, relation, boost over 0.4), first match in this order wins
NARRATIVE_PHRASES = [
    (" caused ", "causes", 0.3), (" causes ", "causes", 0.3), (" because of ", "causes", 0.25),
    (" due to ", "causes", 0.2), (" fixes ", "fixes", 0.3), (" fixed ", "fixes", 0.3),
    (" resolves ", "fixes", 0.3), (" addresses ", "fixes", 0.25), (" replaces ", "supersedes", 0.3),
    (" supersedes ", "supersedes", 0.35), (" instead of ", "supersedes", 0.25),
    (" depends on ", "depends_on", 0.3), (" requires ", "depends_on", 0.25), (" builds on ", "depends_on", 0.25),
    (" based on ", "depends_on", 0.2), (" related to ", "relates_to", 0.2), (" similar to ", "relates_to", 0.2),
    (" evolved from ", "evolves_from", 0.3), (" improved from ", "evolves_from", 0.25),
    (" refined from ", "evolves_from", 0.25),
]

# --- fixed values: conflicts -----------------------------------------------------------------
CORRECTION_PATTERNS = [
    r"(?i)\bactually[,\s]+that\s+was\s+wrong\b",
    r"(?i)\bactually[,\s]+that's\s+(wrong|incorrect|not\s+right)\b",
    r"(?i)\bpreviously\s+(said|mentioned|noted)\s+.*\s+but\b",
    r"(?i)\bcorrection:\s*",
    r"(?i)\bignore\s+(the\s+)?(previous|earlier)\b",
    r"(?i)\bdisregard\s+(the\s+)?(previous|earlier)\b",
    r"(?i)\bwas\s+(wrong|incorrect|mistaken)\b",
    r"(?i)\bturns\s+out\s+.*(wrong|incorrect|not\s+the\s+case)\b",
    r"(?i)\b(supersedes|replaces|overrides)\s+(the\s+)?(previous|earlier|old)\b",
    r"(?i)\b(don't|do\s+not)\s+use\s+.*\s+anymore\b",
    r"(?i)\bno\s+longer\s+(valid|applicable|correct|recommended)\b",
    r"(?i)\bdeprecated\s+(approach|method|pattern|way)\b",
    r"(?i)\bshould\s+have\s+(been|used)\b.*instead\b",
    r"(?i)\bbetter\s+(approach|way|method|solution)\s+is\b",
]
# words one of which every match of the pattern at the same place contains, lower case
CORRECTION_WORDS = [
    ["actually"], ["actually"], ["previously"], ["correction:"], ["ignore"], ["disregard"],
    ["wrong", "incorrect", "mistaken"], ["turns"], ["supersedes", "replaces", "overrides"], ["anymore"], ["longer"],
    ["deprecated"], ["instead"], ["better"],
]
OPPOSING_VERBS = [
    ("add", "remove"), ("added", "removed"), ("create", "delete"), ("created", "deleted"), ("enable", "disable"),
    ("enabled", "disabled"), ("include", "exclude"), ("allow", "deny"), ("permit", "block"),
]

# --- fixed values: patterns ------------------------------------------------------------------
BUG_KEYWORDS = [
    "nil", "null", "undefined", "panic", "crash", "error handling", "race condition", "deadlock", "memory leak",
    "overflow", "off-by-one", "boundary", "timeout", "concurrency",
]
PATTERN_NAME_PREFIX = {
    "bug": "Bug Pattern: ", "refactor": "Refactor Pattern: ", "architecture": "Architecture Pattern: ",
    "anti-pattern": "Anti-Pattern: ", "best-practice": "Best Practice: ",
}
PATTERN_INSIGHT_TAIL = {
    "bug": "This appears to be a recurring bug pattern.",
    "anti-pattern": "This is an identified anti-pattern to avoid.",
    "best-practice": "This is a validated best practice.",
}
PATTERN_INSIGHT_DEFAULT = "This is a recognized pattern in the codebase."
PATTERN_DESCRIPTION = "Automatically detected pattern from recurring observations"

# --- fixed values: the four stop-word lists, each for its own tokenizer --------------------------
SIMILARITY_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall "
    "this that these those and or but if then for from with about into to of in on at by it its which who what "
    "when where how why"
).split()
FTS_STOPWORDS = (
    "what is the a an how does do can could would should where when why which who this that these those it its for "
    "from with about into through during before after above below to of in on at by and or but if then else "
    "function method class file code work works working please help me my i tell show explain describe"
).split()
QUERY_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must can i me "
    "my we our you your it its this that these those what which who whom how why when where to for with about from "
    "in on at by of and or but if then"
).split()
SIGNATURE_STOPWORDS = (
    "the and for with that this from have not are was but all can had were been will when what"
).split()

# --- fixed values: query intent -------------------------------------------------------------------
# first intent with any match wins, in this order
INTENT_PATTERNS = [
    ("error", [
        r"(?i)\b(error|bug|issue|problem|fail|crash|exception|panic)\b",
        r"(?i)\b(fix|debug|troubleshoot|resolve)\b",
        r"(?i)\b(doesn't work|not working|broken)\b",
    ]),
    ("question", [
        r"(?i)^(how|why|what|when|where|which|who)\b",
        r"(?i)\?$",
        r"(?i)\b(explain|describe|understand)\b",
    ]),
    ("implementation", [
        r"(?i)\b(implement|add|create|build|write|code)\b",
        r"(?i)\b(function|method|handler|endpoint|api)\b",
        r"(?i)\b(feature|functionality)\b",
    ]),
    ("architecture", [
        r"(?i)\b(architecture|design|pattern|structure)\b",
        r"(?i)\b(component|module|layer|service)\b",
        r"(?i)\b(flow|pipeline|workflow)\b",
    ]),
]
QUESTION_PREFIXES = [
    "how do i ", "how to ", "how does ", "how is ", "what is ", "what are ", "why does ", "why is ", "where is ",
    "where are ", "when does ", "when is ",
]
BOOST_WORDS = {
    "decisions": " decision chose architecture",
    "changes": " changed modified refactored",
    "how_it_works": " architecture design pattern implements",
}

# --- fixed values: tool-event filtering -------------------------------------------------------------
SKIP_TOOLS = [
    "TodoWrite", "Task", "TaskOutput", "Glob", "ListDir", "LS", "KillShell", "AskUserQuestion", "EnterPlanMode",
    "ExitPlanMode", "Skill", "SlashCommand",
]
# the stricter list applied where events are captured
CAPTURE_SKIP_TOOLS = [
    "Task", "TaskOutput", "Glob", "ListDir", "LS", "KillShell", "AskUserQuestion", "EnterPlanMode", "ExitPlanMode",
    "Skill", "SlashCommand", "Read", "Grep", "WebSearch",
]
TRIVIAL_OUTPUTS = [
    "no matches found", "file not found", "directory not found", "permission denied", "command not found",
    "no such file", "is a directory", "[]", "{}",
]
BORING_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "Gemfile.lock", "poetry.lock",
    ".gitignore", ".dockerignore", ".eslintignore", "tsconfig.json", "jsconfig.json", "vite.config",
    "tailwind.config", "postcss.config",
]
BORING_COMMANDS = [
    "git status", "git diff", "git log", "git branch", "ls ", "pwd", "echo ", "cat ", "which ", "type ", "npm list",
    "npm outdated", "npm audit",
]

# --- fixed values: summary filters -------------------------------------------------------------------
SELF_REFERENCE_PHRASES = [
    "memory extraction", "memory agent", "extraction agent", "hook execution", "hook mechanism",
    "session initialization", "session setup", "session has just started", "session just started",
    "agent initialization", "no technical learnings", "no code or project work", "waiting for the user",
    "waiting for user", "awaiting actual", "awaiting claude code", "awaiting tool", "awaiting user",
    "progress checkpoint", "checkpoint request", "no work has been completed", "no work completed", "no work done",
    "no actual work", "nothing has been completed", "nothing completed", "role definition",
    "operational guidelines", "providing role", "providing guidelines", "extract meaningful observations",
    "meaningful learnings", "analyze tool executions", "observations for future sessions", "empty session",
    "no substantive work", "no meaningful work", "just beginning", "just begun",
]
SUMMARY_SKIP_PHRASES = [
    "hook success", "callback hook", "session start", "sessionstart", "system-reminder", "memory extraction agent",
    "memory agent", "extraction agent", "no technical learnings", "waiting for", "waiting to",
    "no code or project work", "no substantive", "no work has been completed", "no work done", "awaiting tool",
    "awaiting user", "role definition", "operational guidelines", "analyze tool executions",
    "extract meaningful observations",
]
WORK_INDICATORS = [
    ".go", ".ts", ".js", ".py", ".md", ".json", ".yaml", ".yml", "edited", "modified", "created", "deleted",
    "updated", "changed", "added", "removed", "fixed", "implemented", "refactored", "```", "lines ", "function ",
    "const ", "var ", "let ", "type ", "struct ", "class ", "def ", "func ",
]

# --- fixed values: defaults ------------------------------------------------------------------------------
CLUSTER_THRESHOLD = 0.4
MIN_RELATION_CONFIDENCE = 0.4
MAX_CANDIDATES = 50
KEEP_OBSERVATIONS_PER_PROJECT = 100
KEEP_PROMPTS = 500
SUPERSEDED_RETENTION_MS = 3 * 24 * 3600 * 1000
RESCORE_AFTER_MS = 6 * 3600 * 1000
RESCORE_BATCH = 500
DUPLICATE_PROMPT_WINDOW_MS = 10_000
PATTERN_MATCH_MIN = 0.3
PATTERN_MATCH_LIMIT = 100
RELEVANCE_THRESHOLD = 0.3
RERANK_ALPHA = 0.7
CONTEXT_LIMIT = 100
CONTEXT_FULL = 25
DOC_OBSERVATION, DOC_SUMMARY, DOC_PROMPT, DOC_PATTERN = "observation", "session_summary", "user_prompt", "pattern"
