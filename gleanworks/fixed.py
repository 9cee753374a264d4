"""Fixed values that results depend on.

Everything here is data: enumerations, thresholds, patterns and policy rows.
No logic lives in this module.
"""

# --- fixed values: enumerations -------------------------------------------------
SOURCE_TYPES = ["WEBSITE", "API", "DOCUMENT"]
RECORD_SOURCES = ["SCRAPING", "DOCUMENT", "API"]
VALIDATION_STATUSES = ["VALID", "INVALID", "PARTIAL"]
JOB_STATUSES = ["PENDING", "SCHEDULED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "RETRYING"]
CLASSIFICATIONS = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]  # ascending clearance
SORT_FIELDS = ["createdAt", "updatedAt", "uploadedAt", "fileName", "fileSize", "status"]
SELECTOR_TYPES = ["css", "xpath"]
AUTH_TYPES = ["NONE", "BASIC", "TOKEN", "OAUTH"]
SCRAPING_JOB_ROW_STATUSES = ["pending", "running", "completed", "failed"]
DOCUMENT_ROW_STATUSES = ["queued", "processing", "completed", "error"]

# --- fixed values: allowed status transitions --------------------------------------
STRICT_TRANSITIONS = [
    ("PENDING", "RUNNING"),
    ("PENDING", "FAILED"),
    ("RUNNING", "COMPLETED"),
    ("RUNNING", "FAILED"),
    ("RUNNING", "RETRYING"),
    ("RETRYING", "RUNNING"),
    ("RETRYING", "FAILED"),
    ("FAILED", "RETRYING"),
]
SCHEDULING_TRANSITIONS = [
    ("PENDING", "SCHEDULED"),
    ("SCHEDULED", "RUNNING"),
    ("PENDING", "CANCELLED"),
    ("SCHEDULED", "CANCELLED"),
    ("RUNNING", "CANCELLED"),
    ("RETRYING", "CANCELLED"),
]

# --- fixed values: roles and permissions -------------------------------------------
ROLE_PERMISSIONS = {
    "ADMIN": ["scraping:full", "documents:full", "data:full", "config:full"],
    "DEVELOPER": [
        "scraping:create", "scraping:read", "documents:create",
        "documents:read", "data:read", "config:read",
    ],
    "DATA_ENGINEER": [
        "scraping:read", "documents:create", "documents:read",
        "data:read", "data:export", "config:read",
    ],
    "API_CONSUMER": ["data:read"],
}

# --- fixed values: quality thresholds ----------------------------------------------
VALID_SCORE = 80.0
PARTIAL_SCORE = 56.0
WORDS_PER_SENTENCE = 20
MIN_COMPLETENESS = 0.95
MIN_ACCURACY = 0.98
MIN_SUCCESS_RATE = 0.999
MAX_ERROR_RATE = 0.001
MIN_TEXT_CONFIDENCE = 0.75
MIN_ENTITY_CONFIDENCE = 0.75
MIN_RESULT_CONFIDENCE = 0.8
MIN_PAGE_CONFIDENCE = 0.6
DEFAULT_ENTITY_CONFIDENCE = 0.8
FULL_CONFIDENCE_LENGTH = 20
MAX_ATTEMPTS = 3
MAX_CPU_PERCENT = 95
MAX_PROCESSING_MS = 300000
MAX_RANGE_DAYS = 365
MAX_TIMELINESS_MINUTES = 15
QUALITY_TARGETS = {
    "completeness": 0.999,
    "accuracy": 0.98,
    "timeliness": 1.0,
    "consistency": 1.0,
    "uniqueness": 1.0,
}

# --- fixed values: content limits --------------------------------------------------
MAX_HTML_SIZE = 10 * 1024 * 1024
MAX_TEXT_LENGTH = 1000000
MAX_URL_LENGTH = 2048
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_FILE_NAME = 255
CHUNK_SIZE = 1024 * 1024
CONTEXT_CHARS = 50
MAX_METRIC_LABELS = 10
MAX_TAGS = 10
MAX_SEARCH_LENGTH = 100
EXPORT_CAP = 1000
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100

# --- fixed values: patterns --------------------------------------------------------
# White space as ECMAScript defines it: ASCII blanks, every Unicode separator, U+FEFF.
SPACE_CLASS = r"\s\p{Z}\x{FEFF}"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
UUID_V4 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
UUID_ANY = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SEMVER = r"^\d+\.\d+\.\d+$"
HEX_64 = r"^[a-fA-F0-9]{64}$"
RECORD_ID = r"^[a-zA-Z0-9_-]+$"
FILE_NAME = r"^[\w\-. ]+$"
HTTP_URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
CRON = r"^(\*|[0-9,\-*/]+)\s+(\*|[0-9,\-*/]+)\s+(\*|[0-9,\-*/]+)\s+(\*|[0-9,\-*/]+)\s+(\*|[0-9,\-*/]+)$"
TIMEZONE = r"^[A-Za-z_/]+/[A-Za-z_]+$"
BLOCKED_HOST = r"^localhost$|^127\.|^192\.168\.|^10\.|^172\.(1[6-9]|2[0-9]|3[0-1])\."
SEARCH_TEXT = r"^[a-zA-Z0-9_. -]+$"
PII_DETECT = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
}
PII_MASK = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+\d{1,3}[- ]?)?\d{10}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "creditCard": r"\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}",
}

# --- fixed values: names ------------------------------------------------------------
SENSITIVE_FIELDS = ["password", "token", "apikey", "secret"]
AUDITED_METHODS = ["POST", "PUT", "DELETE", "PATCH"]
AUDITED_PATHS = ["/api/v1/data", "/auth"]
REQUIRED_RESULT_FIELDS = ["id", "jobId", "sourceType", "sourceUrl", "timestamp"]
LANDING_FLAGS = ["PHI_SCAN_REQUIRED", "REGULATORY_DOCUMENT"]
RETRYABLE_CODES = ["DEADLINE_EXCEEDED", "INTERNAL", "RESOURCE_EXHAUSTED", "SERVICE_UNAVAILABLE"]
RETRYABLE_TYPES = ["NETWORK", "TIMEOUT", "PARSING"]
CRITICAL_TYPES = ["AUTHENTICATION_ERROR", "INTERNAL_ERROR"]

# --- fixed values: MIME types, extensions, signatures --------------------------------
MIME_EXTENSIONS = {
    "application/pdf": "pdf",
    "image/jpeg": "jpeg",
    "image/png": "png",
    "image/tiff": "tiff",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
}
EXTENSION_MIMES = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "txt": "text/plain",
    "html": "text/html",
    "json": "application/json",
}
FALLBACK_MIME = "application/octet-stream"
FILE_SIGNATURES = {
    "application/pdf": "25504446",
    "image/jpeg": "FFD8FF",
    "image/png": "89504E47",
    "image/tiff": "49492A00",
}

# --- fixed values: text classification rules -----------------------------------------
TEXT_CATEGORIES = [
    {
        "category": "DRUG_INFORMATION",
        "keywords": ["mg", "dosage"],
        "confidence": 0.95,
        "subcategories": ["DOSAGE", "INTERACTIONS"],
        "hierarchy": ["PHARMACEUTICAL", "DRUG"],
        "rules": ["DRUG_PATTERN_MATCH"],
    },
    {
        "category": "CLINICAL_TRIALS",
        "keywords": ["trial", "study"],
        "confidence": 0.90,
        "subcategories": ["METHODOLOGY", "RESULTS"],
        "hierarchy": ["RESEARCH", "TRIALS"],
        "rules": ["TRIAL_PATTERN_MATCH"],
    },
]

# --- fixed values: HTML allow lists --------------------------------------------------
ALLOWED_TAGS = [
    "p", "br", "b", "i", "em", "strong", "span", "div", "ul", "ol", "li",
    "table", "thead", "tbody", "tr", "th", "td", "a", "h1", "h2", "h3", "h4", "h5",
]
ALLOWED_ATTRIBUTES = {
    "a": ["href", "title"],
    "td": ["rowspan", "colspan"],
    "th": ["rowspan", "colspan"],
    "*": ["class"],
}
ALLOWED_SCHEMES = ["http", "https", "mailto"]
LINK_ATTRIBUTES = {"target": "_blank", "rel": "noopener noreferrer"}

# --- fixed values: retention ---------------------------------------------------------
# (data type, days in active storage, days until deletion)
RETENTION_DAYS = [
    ("raw", 90, 365),
    ("processed", 180, 730),
    ("system_logs", 30, 365),
    ("audit_logs", 365, 2555),
]
ARCHIVE_DAYS = 2555
STANDARD_DAYS = 365
LIFECYCLE_AGE_DAYS = 90
LIFECYCLE_NEWER_VERSIONS = 3
COLD_AGE_DAYS = 365
RETENTION_LITERALS = {"default": "90d", "regulatory": "7y", "archived": "1y"}
LANDING_RETENTION_DAYS = 90

# --- fixed values: rate and alert rules ----------------------------------------------
# (rule, window seconds, max requests per key)
RATE_LIMITS = [
    ("query", 900, 100),
    ("write", 900, 50),
    ("delete", 900, 20),
    ("scraping", 60, 100),
    ("create_job", 60, 10),
]
# (error type, errors per minute that raise an alert)
ERROR_ALERTS = [
    ("NETWORK", 5),
    ("RATE_LIMIT", 10),
    ("AUTHENTICATION", 3),
    ("VALIDATION", 5),
    ("SYSTEM", 1),
]
# policy: (window s, per-series aligner, comparison, threshold, duration s, auto close s, notify period s)
ALERT_POLICIES = {
    "response_time": (60, "p95", "GT", 500.0, 300, 1800, None),
    "api_error_rate": (60, "mean", "GT", 0.001, 300, 1800, None),
    "request_rate": (60, "rate", "GT", 1000.0, 300, 1800, None),
    "memory_usage": (60, "max", "GT", 85.0, 300, 1800, None),
    "cpu_usage": (60, "max", "GT", 80.0, 300, 1800, None),
    "processing_time": (60, "mean", "GT", 120.0, 300, 7200, None),
    "processing_errors": (300, "rate", "GT", 0.001, 300, 3600, 300),
    "throughput": (3600, "rate", "LT", 100.0, 900, 7200, None),
    "job_success_rate": (300, "mean", "LT", 99.9, 300, 1800, 900),
    "scraping_errors": (300, "mean", "GT", 0.001, 300, 600, 600),
    "job_time": (300, "mean", "GT", 120.0, 300, 900, 900),
}
LATENCY_BUCKETS = [0.1, 0.5, 1.0, 1.5, 2.0, 5.0]
SIZE_BUCKETS = [512.0, 1024.0, 5120.0, 10240.0, 51200.0, 102400.0]
BREAKER_ERROR_PERCENT = 50.0
LOCKOUT_FAILURES = 3
MIN_DOCS_PER_HOUR = 100
WATERMARK = "10 minutes"
PROGRESS_BY_STATUS = {"PENDING": 0, "PROCESSING": 50, "VALIDATING": 75, "COMPLETED": 100, "FAILED": 0}
