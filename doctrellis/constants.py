"""Patterns, word lists and tables whose exact content decides results.

Everything in this module is data that has to agree with the documents being analysed.
Patterns are written in the Java dialect; ``(?U)`` makes white space and word characters
Unicode-aware.
"""

# --- fixed values: line breaks a document is split on --------------------------------
LINE_BREAK = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"

OTHER_BREAK = "[\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"

# --- fixed values: patterns of the reference-integrity checks ---------------------------
LINT_HEADING = r"(?U)^#{2,}\s+(.*\S)\s*$"
APPLY_REF = r'(?U)apply\s+"(#{2,}\s*[^"]+)"'
READ_TARGET = r"(?U)Read\s+`([^`]+)`"
SUBAGENT = r"(?U)subagent_type[=:]\s*`?([a-z][a-z0-9-]*)`?"
PAYLOAD_KEY = r"^([A-Z][A-Z0-9_]*):"
PAYLOAD_KEY_AFTER_CONDITION = r"(?U)^\s*[（(][^）)]*[）)]\s*([A-Z][A-Z0-9_]*):"
QUOTED_KEY = r"`([A-Z][A-Z0-9_]*)`"
PLACEHOLDER = r"\{([A-Z][A-Z0-9_]*)\}"
FLAG = r"--[a-z][a-z0-9-]*"
SCRIPT_NAME = r"(?U)([a-z_]+\.py)\b"
BARE_WORD = r"^[a-z][a-z0-9-]*$"
HELP_GROUP = r"\{([a-z0-9,_-]+)\}"
NAME_LINE = r"(?U)^name:\s*(\S+)"
TRAILING_PARENTHESIS = r"(?U)\s*[\(（][^()（）]*[\)）]\s*$"

# --- fixed values: patterns of structural profiling ------------------------------------
ANY_HEADING = r"(?U)^#{1,6}\s+(.*\S)\s*$"
FRONTMATTER_KEY = r"(?U)^([a-zA-Z][\w-]*):"
ARTIFACT_ID = r"(?U)\b((?:SP|UR|SR|CR)-[0-9A-Za-z-]+)\b"
UNREPLACED = r"\{[A-Z][A-Z0-9_]*\}"
MERMAID_FENCE = "```mermaid"
CODE_FENCE = "```"
ISO_DATE = r"(?U)\d{4}-\d{2}-\d{2}"
DATE_MASK = "{DATE}"
CONFIG_EDGES = r"(?U)^[\s\x1F]+|[\s\x1F]+$"  # the unit separator is white space to the loader
CONFIG_LINE = r"(?U)^[\s\x1F]*+-?[\s\x1F]*+`?([A-Z_][A-Z0-9_]*)`?[\s\x1F]*[:=][\s\x1F]*(.+)$"
CONFIG_NOTE = r"(?U)[\s\x1F]+#.*$"

# --- fixed values: section titles and words read by the input-contract parser ----------
REQUIRED_SECTION = "inputs (provided by the caller)"
OPTIONAL_SECTION = "optional input"
OPTIONAL_WORD = "optional"
ONLY_WHEN_WORD = "のみ"

# --- fixed values: placeholders that are worked examples, not slots to fill ------------
EXAMPLE_PLACEHOLDERS = (
    "ENTITY_A", "ENTITY_B", "STATE_A", "STATE_B", "STATE_C",
    "DB", "GPIO", "UART", "UART1", "ADDRESS", "RESOURCE", "METHOD",
    "M", "N", "NNN", "YYYY", "DATE", "DOMAIN", "ERROR_TYPE", "CONST_NAME",
    "SIDE_EFFECTS_DFD_PLACEHOLDER",
)

# --- fixed values: artefacts left out of structural profiling --------------------------
REVIEW_FOLDER = "review"
REVIEW_BRIEF = ".review-brief.md"

# --- fixed values: requirement notation -------------------------------------------------
GROUP_NAME = r"^＜.+＞$"
REQUIREMENT_ID = r"^[A-Za-z][A-Za-z0-9_-]*$"
AMBIGUOUS_WORDS = ("等", "etc", "その他", "T.B.D.", "TBD")
NEGATIVE_WORDS = ("しない", "ない", "not ", "never ")
DIVISION_AXES = ("時系列分割", "構成分割", "状態分割", "共通分割")
NAMESPACED_ID = r"^CR-\d{4}-\d+-(?:UR|SR|SP)-"
SHORT_ID = r"^(?:UR|SR|SP)-"
VERIFIED_GLYPHS = ("□□□", "■□□", "■■□", "■■■")
PROGRESS_GLYPHS = {
    "⬜": "not started",
    "🔄": "in progress",
    "👀": "waiting for review",
    "🔁": "returned",
    "✅": "done",
    "⏭️": "skipped",
}
PROMOTED_IMPACT = ("高", "中")

# --- fixed values: thresholds named by the documents -------------------------------------
COVERAGE_THRESHOLD = 80
TEST_CASE_MAX_COUNT = 50
SCALE_LIMITS = {"UR": 20, "module": 10, "SP": 50, "test_case": TEST_CASE_MAX_COUNT}
TEXT_CHANGE_RATIO = 0.2
BUDGET_MARGIN = 1.5
ERROR_TEXT_CHARS = 200

# --- fixed values: line-comment markers by file extension (our choice of languages) -----
LINE_COMMENTS = {
    "py": "#", "sh": "#", "rb": "#", "yml": "#", "yaml": "#",
    "c": "//", "h": "//", "cpp": "//", "hpp": "//", "java": "//", "kt": "//",
    "js": "//", "ts": "//", "go": "//", "rs": "//", "swift": "//", "cs": "//",
    "sql": "--", "lua": "--",
}

# Lines of the run and suite reports (fixed values).
RUN_LINE = "[%s] mode=%s model=%s -> %s"
RUN_COST = " ($%s)"
RUN_VIOLATION = "    ✗ %s"
FALSE_FAILURES = "偽失敗率: %d/%d"
TOTAL_COST = "累積コスト: $%s / 上限 $%s（工程数 %d）"
SUITE_HEAD = "=== unit (unittest) ==="
SUITE_LINE = "%s %s  %s"
LINT_COUNTS = "checks: errors=%d warnings=%d"
