"""Default parameter tables and limits.

Everything here is a fixed value: word lists, weights, thresholds, marker texts
and patterns whose exact content decides the results.  Operators take them as
default arguments, so a caller can pass another table instead.
"""

# --- fixed values: Unicode white space (trim set and regex class) ------------
WS_CHARS = "".join(
    map(chr, [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
WS_CLASS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# --- fixed values: scan globs, suffix classes --------------------------------
CORPUS_GLOBS = [
    "*.txt", "*.md", "*.log", "*.yaml", "*.yml", "*.json", "*.ini", "*.cfg", "*.conf", "*.xml",
    "*.csv", "*.service", "*.sh", "*.py", "*.c", "*.cc", "*.cpp", "*.cxx", "*.h", "*.hpp",
    "*.cmake", "*.pdf", "*.docx",
]
RESERVED_FILE_PREFIX = ".kb_"
SUFFIX_TYPES = {
    "log": ["log"],
    "config": ["yaml", "yml", "json", "xml", "ini", "cfg", "conf", "service"],
    "doc": ["md", "txt", "pdf", "docx", "csv"],
    "code": ["cpp", "cxx", "cc", "c", "h", "hpp", "py", "sh", "cmake"],
}

# --- fixed values: role rules, applied in this order -------------------------
ROLE_HEAD_CHARS = 4000
ROLE_LOG_WORDS = ["alarm", "traceback"]
ROLE_SCENARIO_WORDS = ["hld", "lld", "topology", "architecture", "design", "scenario", "ciq"]
ROLE_PROCEDURE_WORDS = [
    "runbook", "mop", "operator training", "training manual", "procedure", "deployment", "install",
    "bootstrap", "workflow",
]
ROLE_REFERENCE_WORDS = ["guide", "manual", "reference", "concatenated", "release notes", "overview"]

# --- fixed values: query tokeniser -------------------------------------------
QUERY_STOP_WORDS = [
    "the", "and", "for", "with", "from", "into", "that", "this", "what", "when", "where", "which",
    "your", "through", "create", "write", "format", "whole", "please", "show", "explain", "about",
]
QUERY_SYNONYMS = {
    "deploy": ["deployment", "install", "bootstrap"],
    "deployment": ["deploy", "install"],
    "runbook": ["mop", "playbook", "procedure"],
    "mop": ["runbook", "procedure"],
    "hld": ["architecture", "topology"],
    "lld": ["design", "implementation"],
    "k8s": ["kubernetes"],
    "harbor": ["registry"],
}

# --- fixed values: local vector tokeniser ------------------------------------
EMBED_SYNONYMS = {
    "deploy": ["deployment", "install", "bootstrap"],
    "deployment": ["deploy", "install", "bringup"],
    "runbook": ["mop", "procedure", "playbook"],
    "mop": ["runbook", "procedure"],
    "ciq": ["spreadsheet", "inputs"],
    "controller": ["controllers", "control"],
    "worker": ["workers", "compute"],
    "idrac": ["bmc", "virtualmedia"],
    "vpn": ["globalprotect"],
    "hld": ["topology", "architecture"],
    "lld": ["implementation", "design"],
    "alarm": ["error", "fault"],
    "failed": ["failure", "error"],
    "harbor": ["registry"],
    "k8s": ["kubernetes"],
}
EMBED_DIMS = 192
EMBED_SAFE_CHARS = 1200
EMBED_SAFE_TOKENS = 320
EMBED_BATCH_SIZE = 4
EMBED_BATCH_CHARS = 1800
EMBED_BATCH_TOKENS = 520
TOKEN_DENSE_CHARS = "{}[]()<>:=/\\|@#%&*_+-;,.!?\""

# --- fixed values: search weights --------------------------------------------
ROLE_BIAS = {
    "document_generation": {"scenario": 0.55, "procedure": 0.48, "reference": 0.24, "config": 0.08},
    "troubleshooting": {"log": 0.55, "config": 0.46, "procedure": 0.22, "reference": 0.12},
    "architecture": {"scenario": 0.58, "reference": 0.30, "procedure": 0.15},
    "implementation": {"procedure": 0.55, "config": 0.32, "reference": 0.24, "scenario": 0.18},
    "general": {"procedure": 0.10, "reference": 0.10},
}
PREFERRED_ROLE_BONUS = 0.28
SEARCH_WEIGHTS = {  # lexical weight, semantic weight, threshold
    True: (0.85, 1.55, 0.92),
    False: (0.98, 0.28, 1.00),
}
#: Blocks from which a file counts as very large.
MANY_BLOCKS = 450
FILE_CAP, WIDE_FILE_CAP = 6, 10
WIDE_INTENTS = ("document_generation", "architecture")
MIN_SEMANTIC = 0.38
MAX_LOCAL_HITS = 8
CONFIDENCE_THRESHOLD = 0.95

# --- fixed values: line predicates -------------------------------------------
RE_NUMBERED_HEADING = r"^\d+(?:\.\d+){0,4}[.)]?\s+\S+"
RE_TITLED_HEADING = r"^[A-Z][A-Za-z0-9 _/().:+-]{2,80}:\z"
RE_BULLET = r"^(?:[-*+]\s+|\d+[.)]\s+|[a-zA-Z][.)]\s+)"
LEAD_VERBS = [
    "run", "execute", "apply", "install", "configure", "create", "set", "verify", "check", "edit",
    "copy", "add", "remove", "delete", "update", "enable", "disable", "start", "stop", "restart",
    "import", "export", "move", "rename", "assign", "pull", "push", "boot", "deploy", "bootstrap",
    "connect", "mount", "unmount", "launch", "open", "select", "choose", "enter", "type", "use",
]
_VERBS = "|".join(LEAD_VERBS)
RE_LEAD_NUMBERED = (
    r"(?i)^(?:step\s+\d+[:.)]?|\d+(?:\.\d+){0,4}[.)]?|[a-zA-Z][.)])\s+(?:" + _VERBS + r")\b[^\n]{0,220}:?\z"
)
RE_LEAD_IMPERATIVE = r"(?i)^(?:" + _VERBS + r")\b[^\n]{0,220}:\z"
RE_LEAD_STEP = r"(?i)^(?:step\s+\d+[:.)]?|\d+(?:\.\d+){0,4}[.)]?)\s+[^\n]{2,220}:\z"
RE_DOTTED_LEADER = r"^[^\n]{2,220}?\.{3,}\s*\d+\z"
RE_TRAILING_PAGE = (
    r"^(?:\d+(?:\.\d+){0,4}|[ivxlcdmIVXLCDM]+[.)]?)?\s*[A-Za-z\x{A9}][^\n]{2,200}\s\d+\z"
)
RE_TOP_HEADING = r"^\d+[.)]?\s+\S+"
RE_TOP_NUMBER = r"^\d+[.)]?\z"
RE_NUMBER_ONLY = r"^\d+(?:\.\d+){0,4}[.)]?\z"
RE_SPLIT_HEADING_PAIR = r"(?:^|\n)\s*\d+(?:\.\d+){0,3}[.)]?\s*\n\s*[A-Z][^\n]{3,140}"
OUTLINE_RESERVED = [
    "contents", "table of contents", "document version history", "copyright notice",
    "corporate headquarters",
]
STRUCTURE_WORDS = ["table of contents", "contents", "document version history", "overview"]

# --- fixed values: actionability patterns ------------------------------------
RE_COMMAND_LINE = (
    r"(?im)^\s*(?:\$|#|sudo\s+|kubectl\s+|helm\s+|docker\s+|podman\s+|ansible\s+|openstack\s+"
    r"|systemctl\s+|nmcli\s+|ip\s+link)\b"
)
RE_BULLET_LINE = r"(?m)^\s*[-*]\s+"
RE_NUMBERED_LINE = r"(?m)^\s*\d+[.)]\s+"
RE_KEY_VALUE_LINE = r"(?m)^\s*[A-Za-z0-9_.-]+\s*:\s+\S+"
ACTION_WORDS = [  # score, words
    (5, ["warning", "caution", "important"]),
    (4, ["prerequisite", "requirements", "before you begin"]),
    (3, ["example", "sample", "template"]),
    (4, ["yaml", "json", "config", "ini"]),
]
ACTION_QUERY_SUFFIX = (
    "commands snippets yaml config example procedures warnings placeholders appendix"
)
STRUCTURE_QUERY_SUFFIX = " table of contents contents chapter section headings"
EXTRACTION_QUERY_SUFFIX = " " + ACTION_QUERY_SUFFIX + " exact"

# --- fixed values: redaction, in order ---------------------------------------
REDACTION_PATTERNS = [
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    r"(?i)https?://\S+",
    r"(?i)\b[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+\b",
    r"(?i)\b[a-f0-9]{16,}\b",
    r"\b[A-Za-z0-9_\-]{24,}\b",
]
REDACTION_TEXT = " [REDACTED] "
KEYWORD_STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "your", "about", "what", "when",
    "where", "which", "while", "would", "could", "there", "have", "will", "para", "como", "isso",
    "esta", "esse", "de", "da", "do", "dos", "das", "uma", "que", "sem", "por", "com",
]
KEYWORD_DROP = "redacted"

# --- fixed values: external search rules -------------------------------------
RE_EXPLICIT_SEARCH = (
    r"\b(?:search(?:\s+the)?\s+(?:internet|web|online)|search\s+online|web\s+search|internet\s+search"
    r"|look\s+up|lookup|find\s+online|browse\s+for|google)\b"
)
RE_IDENTITY_QUESTION = r"^\s*(?:who\s+is|what\s+is)\b"
PUBLIC_SIGNALS = [
    "who is", "what is", "latest", "current", "recent", "news", "release notes", "known issue",
    "regression", "workaround", "latest version", "changelog", "security advisory", "patch notes",
    "upstream", "cve",
]
LOCAL_SIGNALS = [
    "my project", "our project", "this project", "this repo", "our repo", "repository", "codebase",
    "source tree", "this file", "that file", "which file", "class ", "function ", "method ",
    "cmakelists", "in this app", "our code", "knowledge base", "kb",
]
GROUNDING_SIGNALS = [
    "my project", "our project", "this project", "this repo", "our repo", "repository", "codebase",
    "source tree", "this file", "that file", "which file", "class ", "function ", "method ",
    "pipeline", "module", "cmakelists", "config.json", "yaml", "json", "what can you do",
    "your capabilities", "filesystem", "directory", "folder", "path ", "in this app", "our code",
]
CASUAL_PROMPTS = ["hi", "hello", "hey", "thanks", "thank you", "ok", "okay"]

# --- fixed values: prompt classification -------------------------------------
STRUCTURED_DOC_WORDS = ["mop", "runbook", "playbook", "guide", "markdown", ".md"]
EXTRACTION_VERBS = [
    "extract all", "gather all", "collect all", "capture all", "list all", "scrape", "scraper",
    "exhaustive", "verbatim", "exact snippet", "exact snippets", "exact instruction",
    "preserve indentation", "do not skip",
]
EXTRACTION_TARGETS = [
    "actionable", "snippet", "snippets", "commands", "config snippets", "yaml", "example files",
    "prerequisites", "warnings", "ordered procedures", "placeholders", "appendixes", "appendix",
]
EXTRACTION_PHRASES = [
    "return, where applicable:", "for each item include", "search the entire document",
    "do not skip repeated sections", "use one code block per snippet",
]
STUDY_WORDS = [
    "summary", "summarize", "tutorial", "chapter", "section", "contents", "table of contents", "pdf",
    "manual", "guide", "overview", "high-level design", "hld", "document", "entire", "every section",
    "every chapter", "all sections", "step by step", "cover all", "no gaps", "installation doc",
    "install doc",
]
TROUBLE_WORDS = ["error", "failed", "debug", "alarm", "troubleshoot"]
ARCHITECTURE_WORDS = ["hld", "lld", "topology", "architecture", "design"]
DOC_WORDS = ["mop", "runbook", "playbook", "guide", "procedure", "markdown", ".md"]
IMPLEMENTATION_WORDS = ["deploy", "bootstrap", "install", "bring-up", "bring up"]
INLINE_TROUBLE_WORDS = ["error", "failed", "alarm"]
INLINE_ARCHITECTURE_WORDS = ["architecture", "topology", "hld", "lld"]
INLINE_IMPLEMENTATION_WORDS = ["deploy", "install", "bootstrap"]
TRANSFORM_VERBS = [
    "expand", "rewrite", "transform", "convert", "turn this", "turn the", "tutorial", "teach",
    "explain", "full explanations", "instead of", "elaborate", "improve", "reorganize",
]
TRANSFORM_CUES = [
    "following", "below", "pasted", "source material", "this text", "this summary", "this answer",
]
ANCHOR_STOP_WORDS = [
    "the", "and", "with", "from", "into", "that", "this", "your", "what", "when", "where", "which",
    "will", "would", "should", "about", "through", "whole", "format", "make", "create", "write",
    "need", "using", "para", "como", "isso", "essa", "esse", "uma", "com", "sem", "dos", "das",
    "bare", "metal",
]
ANCHOR_KEEP = [
    "controllers", "workers", "platform", "ciq", "idrac", "globalprotect", "dell", "poweredge",
    "central", "cluster", "cloud", "deploying",
]
ANCHOR_KEEP_PARTS = ["25.09", "24.09", "vpn"]
ANCHOR_CAP = 10

# --- fixed values: section templates per document type -----------------------
SECTION_TEMPLATES = [  # document type, ordinal, title, objective, query, preferred roles
    ("Runbook", 1, "Purpose and scope", "State what the runbook covers and when it applies.",
     "purpose scope applicability", ["scenario", "procedure"]),
    ("Runbook", 2, "Prerequisites", "Capture access, tools, credentials and environment assumptions.",
     "prerequisites access tools credentials", ["procedure", "reference"]),
    ("Runbook", 3, "Execution steps", "Document the sequence of operational actions.",
     "execution steps procedure commands", ["procedure", "reference"]),
    ("Runbook", 4, "Validation", "List checks that confirm the procedure succeeded.",
     "validation checks expected result", ["procedure", "reference"]),
    ("Runbook", 5, "Recovery", "Explain what to do when a step fails.",
     "recovery failure handling rollback", ["procedure", "reference"]),
    ("Guide", 1, "Overview", "Explain the overall objective and environment.",
     "overview objective environment", ["scenario", "reference"]),
    ("Guide", 2, "Assumptions", "Capture key assumptions and constraints.",
     "assumptions constraints", ["scenario"]),
    ("Guide", 3, "Procedure", "Walk through the relevant steps in order.",
     "procedure implementation steps", ["procedure", "reference"]),
    ("Guide", 4, "Validation", "Show how to verify the result.",
     "validation verification checks", ["procedure", "reference"]),
    ("MOP", 1, "Scope and target topology",
     "Define the cluster shape, supported assumptions, node roles and deployment end-state.",
     "scope target topology controllers workers central cloud standard cluster",
     ["scenario", "procedure"]),
    ("MOP", 2, "Assumptions, access and prerequisites",
     "Gather remote access assumptions, VPN requirements, iDRAC access, images, credentials and "
     "installation prerequisites.",
     "prerequisites access vpn globalprotect idrac credentials hardware requirements",
     ["scenario", "procedure", "reference"]),
    ("MOP", 3, "CIQ inputs and planning gates",
     "Map the CIQ spreadsheet to required deployment inputs, addressing, hostnames, networks and "
     "validation before execution.",
     "ciq spreadsheet addressing hostnames management oam network deployment inputs",
     ["scenario", "procedure"]),
    ("MOP", 4, "Bare-metal and host preparation",
     "Prepare DELL PowerEdge hosts, firmware assumptions, boot order, virtual media and "
     "installation staging.",
     "dell poweredge bare metal idrac virtual media boot host preparation firmware",
     ["procedure", "scenario", "reference"]),
    ("MOP", 5, "Distributed platform deployment execution",
     "Describe the sequence from install media to controller and worker bring-up.",
     "platform install bootstrap controller worker deployment bring up",
     ["procedure", "reference"]),
    ("MOP", 6, "Post-deployment validation",
     "List health checks, cluster validation gates and acceptance criteria.",
     "validation health checks system host interface kubernetes cluster acceptance",
     ["procedure", "reference"]),
    ("MOP", 7, "Rollback and recovery points",
     "Identify safe stop points, rollback boundaries and recovery actions during deployment.",
     "rollback recovery restart failure handling deployment", ["procedure", "reference"]),
    ("MOP", 8, "Appendix: commands, artifacts and evidence",
     "Capture command references, expected artifacts, and evidence to retain during the change.",
     "commands artifacts evidence checklist runbook appendix", ["reference", "procedure"]),
]

# --- fixed values: memory rules ----------------------------------------------
RE_REMEMBER = [
    r"(?i)^\s*(?:please\s+)?remember(?:\s+that)?\s*[:,\-]*\s*",
    r"(?i)^\s*note\s+that\s*[:,\-]*\s*",
]
REMEMBER_PREFIXES = ["remember", "please remember", "note that"]
RE_PREFER = [
    r"(?i)^\s*from\s+now\s+on\s*[:,\-]*\s*",
    r"(?i)^\s*i\s+prefer\s*[:,\-]*\s*",
    r"(?i)^\s*prefer\s*[:,\-]*\s*",
    r"(?i)^\s*(?:please\s+)?always\s*[:,\-]*\s*",
    r"(?i)^\s*default\s+to\s*[:,\-]*\s*",
]
PREFER_PREFIXES = ["i prefer", "prefer ", "default to", "always ", "please always "]
RE_PLATFORM = r"(?i)\b(?:platform|release)\s+(\d+\.\d+)\b"
UNSAFE_PHRASES = [
    "assistant", "system prompt", "developer", "local_context", "external_context",
    "relevant_memories", "session_summary", "hidden reasoning", "chain of thought", "next prompt",
    "prompt loop", "memory loop", "user prompt", "instruction block", "role:", "assistant>",
]
REFUSAL_PHRASE = "don't know based on the provided context"

# --- fixed values: web snippets ----------------------------------------------
HTML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                 ("&#39;", "'")]
ENVELOPE_MARKERS = ["<<<BEGIN_UNTRUSTED_WEB_DATA>>>", "<<<END_UNTRUSTED_WEB_DATA>>>"]
ENVELOPE_REPLACEMENT = "[external content]"
SNIPPET_KEYS = ["content", "snippet", "description", "text", "summary"]
SNIPPET_CHARS = 900

# --- fixed values: markers, tags, failure phrases ----------------------------
STUDY_TRIM_MARKER = "\n[... middle omitted for budget ...]\n"
BUDGET_TRIM_MARKER = "\n[... budget-trimmed ...]\n"
RETRY_TRIM_MARKER = "\n\n<retry_compacted_context/>\n\n"
SECTION_LATER_MARKER = "\n[... later in this section ...]\n"
EXCERPT_LATER_MARKER = "\n[... matching content later in this chunk ...]\n"
PACKET_MARKERS = {
    "doc_packets": "=== DOCUMENT_STUDY_PACKET:",
    "outline_maps": "DOCUMENT_OUTLINE_MAP:",
    "section_packets": "SECTION_COVERAGE_PACKET:",
    "full_docs": "FULL_DOCUMENT_TEXT:",
    "source_blocks": "--- Source:",
    "budget_trims": "[... budget-trimmed ...]",
}
HIDDEN_TAGS = [("<hidden_thinking>", "</hidden_thinking>"), ("<think>", "</think>")]
END_TAG = "<END>"
PERMANENT_FAILURES = ["not found", "unknown model", "no such model", "does not support", "invalid model"]
CONTEXT_FAILURES = ["context length", "input length exceeds", "prompt is too long"]
RUNNER_FAILURES = [
    "model runner has unexpectedly stopped", "internal server error",
    "forcibly closed by the remote host", "wsarecv",
]
VERBOSE_PREFIXES = [
    "ollama request ", "ollama probe request ", "ollama probe response ", "ollama model-list request ",
    "ollama model-list response ", "ollama embedding request ", "ollama embedding response ",
    "ollama response headers received ", "ollama chat response complete ",
]
CODE_SIGNALS = [
    "#include", "int main", "std::", "->", "::", "public static void main", "console.log", "def ",
    "class ", "function ", "import ", "from ", "select ", "insert into", "update ", "delete from",
    "{", "}", ";",
]

# --- fixed values: context budgets -------------------------------------------
CHARS_PER_TOKEN = 3.2
MEMORY_BUDGET = 900
SUMMARY_BUDGET = 1200
OUTLINE_BUDGET = 1400
HISTORY_BUDGET = 2400
EXTERNAL_BUDGET = 2400
EXTERNAL_BUDGET_FIRST_PASS = 1400
LOCAL_BUDGET = 9600
LOCAL_BUDGET_FIRST_PASS = 4800
MAX_HISTORY_TURNS = 8
MAX_MEMORIES = 6
DIAGNOSTIC_LINES = 400

# --- fixed values: stream guards ---------------------------------------------
LOOP_STREAK = 5
LOOP_MIN_CHARS = 6
LOOP_LINE_CHARS = 160
EMA_WEIGHT = 0.3
ETA_CAP_MS = 120000
MAX_CONTINUATIONS = 6
CONTINUATION_TAIL = 3000
FAILURES_BEFORE_PAUSE = 2
FAILURE_PAUSE_MS = 5 * 60 * 1000
PHASE_TIMEOUT_MS = {"headers": 1800000, "first_token": 600000, "inactivity": 300000, "total": 0}
