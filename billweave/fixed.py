"""Fixed values.

Everything in this module has to equal the values other tools in the same
bill-processing flow use, otherwise results differ. They are data, not logic.
"""

# --- fixed values: file intake -------------------------------------------------
SUPPORTED_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".heic", ".heif")
JUNK_NAMES = (".ds_store", "thumbs.db", "desktop.ini", ".localized")
PLACEHOLDER_SUFFIX = ".icloud"
# offline 0x1000, recall on open 0x40000, recall on data access 0x400000
OFFLINE_ATTRIBUTE_MASK = 0x441000
SETTLE_MAX_RESAMPLES = 6
FILENAME_MAX_LENGTH = 180
FILENAME_FALLBACK = "upload"
COLLISION_LAST_NUMBER = 999
INTAKE_MAX_FILE_BYTES = 25 * 1024 * 1024
INTAKE_MAX_FILES = 20
INTAKE_MIME_TYPES = (
    "application/pdf",
    "image/jpeg",
    "image/jpg",
    "image/png",
    "image/heic",
    "image/heif",
    "image/heic-sequence",
    "image/heif-sequence",
)

# --- fixed values: routing and text --------------------------------------------
BITMAP_COVERAGE_FLOOR = 0.75
INVISIBLE_GLYPH_CEILING = 0.9
MIN_NATIVE_CHARS = 50
NATIVE_PAGE_SHARE = 0.5
MAX_PAGES = 10
HEAD_PAGES = 3
TAIL_PAGES = 2
REFERENCE_TEXT_CHARS = 50_000

# --- fixed values: replies -----------------------------------------------------
REPLY_RUNGS = ("json_schema", "json_object", "plain")
REPLY_REQUIRED = ("vendor", "total")
REPLY_KEYS = (
    "vendor",
    "invoice_number",
    "invoice_date",
    "due_date",
    "subtotal",
    "tax",
    "total",
    "currency",
    "suggested_category",
)
REPLY_NOT_OBJECT = "the reply did not contain a JSON object"
REPLY_DETAIL_CHARS = 400
UNSUPPORTED_STATUSES = (400, 404, 422)
CONNECTION_ERROR_PATTERN = "(?i)connection|timed?[ _-]?out|ECONNREFUSED|ENOTFOUND|ECONNRESET|abort"

# --- fixed values: validation --------------------------------------------------
MAX_SAFE_INTEGER = 9007199254740991
ROUNDING_TOLERANCE_CENTS = 2
ARITHMETIC_FLAG = "arithmetic:subtotal+tax!=total"
AGREEMENT_PREFIX = "agreement:"
ABSENCE_WORDS = (
    "null",
    "nil",
    "none",
    "n/a",
    "na",
    "not applicable",
    "not available",
    "not found",
    "unknown",
    "undefined",
    "unspecified",
    "not specified",
    "not provided",
)
MONTHS = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)
# output field name -> parsed_bills column
FIELD_COLUMNS = {
    "vendor": "vendor",
    "invoiceNumber": "invoice_number",
    "invoiceDate": "invoice_date",
    "dueDate": "due_date",
    "subtotalCents": "subtotal_cents",
    "taxCents": "tax_cents",
    "totalCents": "total_cents",
    "currency": "currency",
    "suggestedCategory": "suggested_category",
}
MONEY_FIELDS = ("subtotalCents", "taxCents", "totalCents")
AGREEMENT_FIELDS = ("totalCents", "subtotalCents", "taxCents", "invoiceDate", "invoiceNumber")
PARSE_SCHEMA_VERSION = 2

# --- fixed values: name matching -----------------------------------------------
COMPANY_FORM_WORDS = (
    "llc",
    "lc",
    "llp",
    "lp",
    "plc",
    "pllc",
    "pc",
    "inc",
    "incorporated",
    "corp",
    "corporation",
    "co",
    "company",
    "ltd",
    "limited",
)
TOKEN_WEIGHT = 0.55
CHARACTER_WEIGHT = 0.45
TOKEN_MATCH_FLOOR = 0.88
WINKLER_SCALE = 0.1
WINKLER_PREFIX = 4
WINKLER_FLOOR = 0.7
CANDIDATE_FLOOR = 0.45
SUGGEST_FLOOR = 0.62
AUTO_SCORE = 0.95
AUTO_MARGIN = 0.1
MAX_CANDIDATES = 5

# --- fixed values: reference sync ----------------------------------------------
EXPENSE_ACCOUNT_TYPES = ("Expense",)
PAYMENT_ACCOUNT_TYPES = ("Bank", "Credit Card")
REMOTE_PAGE_SIZE = 1000
VISION_MODEL_PATTERNS = (
    r"gpt-4o",
    r"gpt-4\.1",
    r"gpt-4[-_]?(turbo|vision)",
    r"(^|/)o[134](-|$)",
    r"claude-3",
    r"claude-4",
    r"claude-(opus|sonnet|haiku)",
    r"gemini-(1\.5|2|2\.5|3)",
    r"gemini[\w.-]*-(flash|pro)\b",
    r"llama[\w.-]*vision",
    r"qwen[\w.]*-?vl",
    r"pixtral",
    r"[-_/]vision([-_.]|$)",
)

# --- fixed values: review and posting ------------------------------------------
FILE_HASH_LENGTH = 64
ID_MAX_LENGTH = 64
MIN_AMOUNT_CENTS = 1
MAX_AMOUNT_CENTS = 99999999999
REF_NUMBER_MAX = 21
MEMO_MAX = 4000
BATCH_MAX_ROWS = 500
DUPLICATE_WINDOW_DAYS = 3
GAP_VENDOR = "pick a vendor"
GAP_CATEGORY = "pick a category"
GAP_AMOUNT = "enter an amount like 1336.00"
GAP_AMOUNT_ZERO = "enter an amount greater than zero"
GAP_AMOUNT_LARGE = "check this amount, it looks far too large"
GAP_TXN_DATE = "pick an entry date"
GAP_PAID_FROM = "pick the account that paid it"
GAP_DUE_DATE = "fix the due date"
GAP_REF_NUMBER = "shorten the reference number to 21 characters or fewer"

# --- fixed values: texts shown for a state ---------------------------------------
ENTRY_REMOVED = "Removed"
ENTRY_CONFIRMED = "Entered"
ENTRY_FAILED = "Did not go in"
ENTRY_SENT = "Sending"
ENTRY_PENDING = "Waiting"

BATCH_UNDONE = "Removed"
BATCH_PARTIALLY_UNDONE = "Partly removed"
BATCH_WITH_FAILURES = "Needs another try"
BATCH_COMPLETE = "Sent"
BATCH_OPEN = "Not finished"

BATCH_LINE_ENTERED = "%d of %d entered"
BATCH_LINE_FAILED = "%d did not go in"
BATCH_LINE_REMOVED = "%d later removed"

FILE_POSTED_ON = "Already entered on "
FILE_POSTED = "Already entered"
FILE_DUPLICATE = "Duplicate in this scan"
FILE_NOT_READY = "Not downloaded yet, re-scan shortly"
FILE_UNSUPPORTED = "Unsupported"
FILE_PARSE_FAILED = "Could not read"
FILE_FLAGGED = "Needs review"
FILE_CACHED = "Already read"
FILE_PARSED = "Ready to review"
FILE_LOADED = "Loaded"

NOTICE_ONCE = "Looks like this was already sent on %s."
NOTICE_OFTEN = "Looks like this was already sent %d times, first on %s."
