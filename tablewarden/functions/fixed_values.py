"""Constants whose exact content decides the results."""

# --- Fixed values: PII rules (name, priority, value patterns, column-name hints) ---
DEFAULT_PII_RULES = [
    (1, "email_detection", 10, [r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"],
     ["email", "e_mail", "email_address", "user_email"]),
    (2, "ssn_detection", 10, [r"^\d{3}-\d{2}-\d{4}$", r"^\d{9}$"],
     ["ssn", "social_security", "social_security_number"]),
    (3, "phone_detection", 20, [r"^\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$"],
     ["phone", "phone_number", "mobile", "cell"]),
    (4, "credit_card_detection", 10, [r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$"],
     ["credit_card", "card_number", "cc_number"]),
    (5, "ip_address_detection", 30, [r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"],
     ["ip", "ip_address", "client_ip", "source_ip"]),
]
NAME_MATCH_CONFIDENCE = 0.9
UNKNOWN_CONFIDENCE = 0.5

# --- Fixed values: aggregate function names ---
AGGREGATE_FUNCTIONS = [
    "SUM", "COUNT", "AVG", "MIN", "MAX", "STDDEV", "STDDEV_POP", "STDDEV_SAMP", "VARIANCE", "VAR_POP", "VAR_SAMP",
    "ARRAY_AGG", "STRING_AGG", "GROUP_CONCAT", "LISTAGG", "BOOL_AND", "BOOL_OR", "EVERY", "BIT_AND", "BIT_OR",
    "BIT_XOR", "APPROX_COUNT_DISTINCT", "APPROX_PERCENTILE", "PERCENTILE_CONT", "PERCENTILE_DISC", "FIRST_VALUE",
    "LAST_VALUE", "NTH_VALUE",
]

# --- Fixed values: words in a transformation that may anonymise data ---
ANONYMISING_WORDS = ["HASH", "MD5", "SHA", "MASK", "TRUNCATE", "SUBSTR", "ROUND"]

# --- Fixed values: quality scores ---
SMALL_FILE_BYTES = 128 * 1024 * 1024
QUALITY_WEIGHTS = {"completeness_score": 0.4, "freshness_score": 0.4, "file_health_score": 0.2}

# --- Fixed values: lineage ---
MAX_LINEAGE_COLUMN_BYTES = 256

# --- Fixed values: name limits (bytes) ---
MAX_DATASET_NAME = 255
MAX_FIELD_NAME = 255
MAX_TAG = 100
MAX_IDENTIFIER = 100
MAX_CONTRACT_NAME = 128
MAX_CONTRACT_PATTERN = 256
MAX_URL = 2048

# --- Fixed values: alerts ---
ALERT_COOLDOWN_SECS = 3600

# --- Fixed values: usage ---
PERIOD_DAYS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}

# --- Fixed values: throttling (requests per window) ---
THROTTLE_WINDOW_SECS = 60
ANONYMOUS_LIMIT = 100
AUTHENTICATED_LIMIT = 1000
TIER_LIMITS = {"free": 100, "standard": 1000, "premium": 5000, "enterprise": 10000}
THROTTLE_STATE_TTL_SECS = 600

# --- Fixed values: request latency buckets (seconds) ---
LATENCY_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

