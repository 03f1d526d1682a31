"""Fixed values. They decide results and therefore have to be exactly these."""

# Cells that mean "no value", "true" and "false" (compared casefolded).
NULL_WORDS = ("", "-", "n/a", "na", "none", "null", "unknown")
TRUE_WORDS = ("true", "yes", "y")
FALSE_WORDS = ("false", "no", "n")

# Currency signs and codes of a number cell.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP"}
CURRENCY_CODES = ("USD", "CAD", "EUR", "GBP")

# Group labels which denote totals of other rows.
TOTAL_LABELS = ("all", "grand total", "overall", "subtotal", "total")

# Words of a column name that carry no meaning when matched against a phrase.
COLUMN_STOP_WORDS = (
    "a", "all", "and", "are", "by", "count", "does", "each", "every", "for", "from", "group", "have", "how",
    "in", "is", "list", "many", "of", "on", "or", "record", "records", "show", "summarize", "summary", "table",
    "the", "total", "what", "which", "with",
)

# Stop words of a search question.
QUERY_STOP_WORDS = (
    "about", "all", "and", "are", "does", "did", "do", "for", "from", "have", "how", "into", "is", "me", "our",
    "please", "show", "that", "the", "this", "tell", "was", "what", "what's", "whats", "when", "where",
    "which", "with",
)

# States in which a run is published.
PUBLISHED_STATES = ("ready", "partial", "failed")

# Words between a field and the scope that it is asked for; forms after "who" that state no deed, and helpers before a deed.
SCOPE_WORDS = ("at", "for", "from", "in", "of", "on")
STATIVE_VERBS = ("are", "did", "does", "has", "is", "was", "were")
HELPING_VERBS = ("can", "could", "did", "does", "may", "might", "must", "should", "will", "would")

# Generic words left out when a looked-up cell is compared with its request.
REQUEST_NOISE = ("binder", "document", "file", "quote", "revision", "source", "state", "stated")

# First header and second header of field/value tables.
ROW_LABEL_HEADERS = ("control", "field", "item", "record", "subjectivity", "term")
ROW_VALUE_HEADERS = ("position", "quoted term", "quoted value", "recorded position", "status", "value")

# MIME type -> (parser, ingestion mode, allowed extensions).
FORMATS = {
    "application/csv": ("csv", "download_binary", ("", ".csv")),
    "text/csv": ("csv", "download_binary", ("", ".csv")),
    "application/pdf": ("pdf", "download_binary", ("", ".pdf")),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document":
        ("docx", "download_binary", ("", ".docx")),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet":
        ("xlsx", "download_binary", ("", ".xlsx")),
    "text/plain": ("plain_text", "download_text", ("", ".md", ".markdown", ".text", ".txt")),
    "text/markdown": ("plain_text", "download_text", ("", ".md", ".markdown", ".mdown")),
}
EXPORTED_DOCUMENT = "application/vnd.google-apps.document"
SHORTCUT = "application/vnd.google-apps.shortcut"
FOLDER = "application/vnd.google-apps.folder"

# Internal file states and the public state shown for each.
PUBLIC_STATE = {
    "discovered": "queued", "admitted": "queued",
    "downloading": "parsing", "parsed": "parsing", "embedding": "parsing",
    "ready": "ready",
    "retryable_failed": "failed", "terminal_failed": "failed",
    "unsupported": "unsupported", "capped": "capped",
}
PENDING_STATES = ("discovered", "admitted")
PROCESSING_STATES = ("downloading", "parsed", "embedding")
FAILED_STATES = ("retryable_failed", "terminal_failed")

# Error codes that move a failure into its own coverage count.
INACCESSIBLE_CODES = ("inaccessible", "not_found")
UNSAFE_CODES = (
    "docx_archive_too_large", "encrypted_pdf", "invalid_csv", "invalid_docx", "invalid_encoding", "invalid_xlsx",
    "invalid_pdf", "no_text", "ocr_no_text",
)

# Legal changes of a file's state.
LEGAL_TRANSITIONS = (
    ("discovered", "admitted"), ("discovered", "unsupported"), ("discovered", "capped"),
    ("admitted", "downloading"), ("downloading", "parsed"), ("parsed", "embedding"), ("parsed", "ready"),
    ("embedding", "ready"), ("downloading", "capped"),
    ("downloading", "retryable_failed"), ("downloading", "terminal_failed"),
    ("parsed", "retryable_failed"), ("parsed", "terminal_failed"),
    ("embedding", "retryable_failed"), ("embedding", "terminal_failed"),
)

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")

# Phrases that stand for a value.
STATUS_PHRASES = ("included", "none", "not applicable", "not available", "not included", "not provided", "not quoted", "not received", "pending", "tbd",
                  "unknown", "unlimited", "waived")

# Verbs between a label and its value, verbs by which a source reports one, and words that make a number a change of another.
COPULAS = ("is", "are", "was", "were")
REPORTING_VERBS = ("list", "lists", "report", "reports", "show", "shows", "state", "states", "support", "supports")
REPORTERS = ("document", "file", "source")
CHANGE_WORDS = ("higher", "lower", "increase", "decrease", "difference")

# Words that raise or lower the authority of a source, what can be denied, what denies it, and what an id of control is an id of.
CONTROL_WORDS = ("approved", "authorized", "change control", "change controlled", "executed", "ratified", "signed")
CONTROL_THINGS = ("appointment letter", "approval", "authorization", "change request", "meeting resolution", "ratification")
CONTROL_IDS = ("approval", "change", "revision", "signature", "version")
DRAFT_WORDS = ("anecdotal", "draft", "estimate", "informal", "narrative", "note", "proposed", "rumor", "unapproved", "uncontrolled", "unsupported", "unverified")
DENIALS = ("lack", "lacks", "no", "not", "pending", "until", "without")

# Orders to the reader of a text.
ORDER_VERBS = ("disregard", "ignore")
ORDER_TIMES = ("previous", "prior")
ORDER_PHRASES = ("system prompt", "you are chatgpt")

# Words by which a question asks for a time.
TIME_WORDS = ("date", "dated", "effective", "expiration", "expire", "expired", "expires", "issued", "period", "renewal")
