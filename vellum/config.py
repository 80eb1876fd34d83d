"""Defaults and fixed values.

FIXED VALUES: the entries marked below must equal the behaviour being matched (keyword
dictionary and its order, separator list, supported extensions, sizes, thresholds). They are
stated plainly, in their natural order, and nowhere else in the package.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------
# FIXED VALUES -- keyword dictionary for classification. Order of categories matters: ties
# go to the category listed first. GENERAL has no keywords and is the fallback category.
# ---------------------------------------------------------------------------------------
KEYWORDS: dict[str, list[str]] = {
    "HR": [
        "human resources", "employee", "recruitment", "onboarding", "payroll", "benefits",
        "personnel", "staffing", "compensation", "performance review", "dismissal",
        "termination", "hiring", "talent acquisition", "hrms", "human capital", "workforce",
        "timesheet", "leave policy",
    ],
    "PROCUREMENT": [
        "procurement", "tender", "vendor", "supplier", "purchase order", "invoice", "po",
        "rfp", "request for proposal", "rfq", "request for quotation", "sourcing",
        "purchasing", "supply chain", "logistics", "bidding", "contract award", "requisition",
    ],
    "LEGAL": [
        "agreement", "contract", "legal", "compliance", "terms and conditions", "nda",
        "non-disclosure", "statute", "regulation", "litigation", "arbitration",
        "intellectual property", "ip", "gdpr", "liability", "clause", "privacy policy",
        "indemnity", "jurisdiction",
    ],
    "FINANCE": [
        "finance", "budget", "audit", "financial statement", "tax", "revenue", "p&l",
        "expenditure", "balance sheet", "income statement", "cash flow", "equity", "debt",
        "asset", "liability", "quarterly report", "annual report", "earnings", "fiscal",
        "depreciation",
    ],
    "TECHNICAL": [
        "technical specification", "api", "software", "hardware", "architecture", "database",
        "deployment", "infrastructure", "cybersecurity", "saas", "paas", "iaas", "network",
        "api documentation", "data schema", "bug report", "feature request", "source code",
        "algorithm", "server", "cloud computing", "sdk", "version control",
    ],
    "MARKETING": [
        "marketing", "campaign", "advertising", "brand", "seo", "search engine optimization",
        "social media", "market research", "analytics", "lead generation", "content strategy",
        "public relations", "pr", "customer engagement", "cpm", "cpc", "conversion rate",
    ],
    "OPERATIONS": [
        "operations", "workflow", "process improvement", "quality assurance", "qa", "qc",
        "logistics", "inventory management", "business continuity", "supply chain management",
        "standard operating procedure", "sop", "efficiency", "service level agreement", "sla",
    ],
    "GENERAL": [],
}
FALLBACK_KEYWORDS: dict[str, list[str]] = {"GENERAL": []}
DEFAULT_CATEGORY = "GENERAL"
UNCLASSIFIED = "Unclassified"

# FIXED VALUES -- classification sample: first 20 parts joined by newline, first 8000 chars.
SAMPLE_MAX_PARTS = 20
SAMPLE_MAX_CHARS = 8000

# FIXED VALUES -- recursive chunking.
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 500
SEPARATORS: list[str] = ["\n\n", "\n", ".", "?", "!", " ", ""]

# FIXED VALUES -- retrieval.
TOP_K = 10
SIMILARITY_THRESHOLD = 0.5
VECTOR_WIDTH = 768
NO_CONTEXT = "No relevant documents found."
CONTEXT_SEPARATOR = "\n" + "=" * 100 + "\n"
UNKNOWN_SOURCE = "Unknown"
MISSING_META = "N/A"
PEEK_LIMIT = 4000

# FIXED VALUES -- supported corpus file extensions (compared lower-case, without the dot).
SUPPORTED_EXTENSIONS: tuple[str, ...] = (
    "pdf", "txt", "md", "xhtml", "html", "docx", "pptx", "xlsx", "xls", "rtf", "odt",
    "csv", "json", "xml", "yaml", "yml", "epub",
)
MANIFEST_NAME = ".cache.json"

# FIXED VALUES -- sessions.
NEW_CHAT_TITLE = "New Chat"
SESSION_TITLE_PREFIX = "Session "
SESSION_ID_PREFIX_LEN = 8
TITLE_DISPLAY_LEN = 20
PREVIEW_LEN = 100

# FIXED VALUES -- evaluation pass mark.
PASS_THRESHOLD = 0.5


# Semantic chunking: breakpoint when the neighbour distance exceeds mean + k * stddev.
SEMANTIC_STDDEV_K = 3.0

# Prompt templates (our own wording). Placeholders are filled with chained ``replace`` so a
# literal ``%`` or brace in user text is never interpreted.
QUERY_TEMPLATE = (
    "Answer the question using only the context below. If the context does not contain the "
    "answer, say so plainly.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"
)
CHAT_TEMPLATE = (
    "You are continuing a conversation. Use the context and the earlier messages.\n\n"
    "Context:\n{context}\n\nConversation so far:\n{history}\n\nuser: {question}\nassistant:"
)
TITLE_TEMPLATE = (
    "Write a title of three to five words for a chat that begins with this message, "
    "without quotes: {message}"
)
CLASSIFY_TEMPLATE = (
    "Assign the text to exactly one of these categories: {categories}.\n"
    "Reply with JSON of the form {\"category\": \"<name>\"}.\n\nText:\n---\n{text}\n---"
)
