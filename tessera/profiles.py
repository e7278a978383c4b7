"""Detection profiles: patterns, sensitivity levels and keyword lists.

Three profiles exist because the behaviour to match comes in three flavours:

* ``cli``      -- eight PII types, an expectation-style quality suite
                  (``mostly`` thresholds), near-duplicate counting and a
                  penalty for failed industry-pack rules.
* ``function`` -- five PII types, strict zero-violation quality checks,
                  no pack penalty and no near duplicates.
* ``legacy``   -- the older function engine: as ``function`` but a
                  ``**/**/`` date mask and its own check wording and order.

Everything in this module is plain data; the column expressions that use it
live in :mod:`tessera.functions.pii`.  Keyword tests are *substring* tests
on lower-cased text (so ``"no"`` matches ``notes``); that is the behaviour to
reproduce, and ``match="token"`` in :class:`Profile` offers whole-token
matching as an opt-in.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the reference behaviour for right results.
# Patterns are Java-regex compatible (look-aheads included).  Order matters:
# it is the order findings are produced in and the order masks are applied.
# ---------------------------------------------------------------------------
PATTERNS_ALL = [
    ("SSN", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[\-.\s]?)?\(?\d{3}\)?[\-.\s]\d{3}[\-.\s]\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("DATE_OF_BIRTH", r"\b(?:0?[1-9]|1[0-2])[\/\-](?:0?[1-9]|[12]\d|3[01])[\/\-](?:19|20)\d{2}\b"),
    ("PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7,19}\b"),
]

# cli profile
CLI_SENSITIVITY = {
    "low": {"SSN", "CREDIT_CARD", "PASSPORT", "IBAN"},
    "medium": {"SSN", "CREDIT_CARD", "PASSPORT", "IBAN", "PHONE", "DATE_OF_BIRTH"},
    "high": {"SSN", "EMAIL", "PHONE", "CREDIT_CARD", "IP_ADDRESS", "DATE_OF_BIRTH", "PASSPORT", "IBAN"},
}
CLI_SAFE_COL_WORDS = [
    "serial", "product", "order", "ref", "sku", "part", "item",
    "tracking", "invoice", "ticket", "model", "batch", "barcode",
    "upc", "isbn", "asin", "code", "number", "num", "no",
]
CLI_RISKY_COL_WORDS = [
    "ssn", "sin", "identity", "social", "patient", "member", "employee",
    "person", "contact", "profile", "account", "taxpayer", "national",
    "passport", "driver", "license", "dob", "birth", "gender", "race",
]
CLI_RISKY_CONTEXT_WORDS = [
    "social security", "ssn", "identity", "personal id", "date of birth",
    "dob", "taxpayer", "national id", "passport", "confidential", "private",
    "sensitive", "medical", "diagnosis", "patient",
]

# function profile
FUNCTION_TYPES = ["SSN", "EMAIL", "PHONE", "CREDIT_CARD", "DATE_OF_BIRTH"]
FUNCTION_SENSITIVITY = {
    "low": {"SSN", "CREDIT_CARD"},
    "medium": {"SSN", "CREDIT_CARD", "PHONE", "DATE_OF_BIRTH"},
    "high": {"SSN", "EMAIL", "PHONE", "CREDIT_CARD", "DATE_OF_BIRTH"},
}
FUNCTION_SAFE_COL_WORDS = [
    "serial", "product", "order", "ref", "sku", "part", "item", "tracking", "code", "number", "num",
]
FUNCTION_RISKY_COL_WORDS = [
    "ssn", "identity", "social", "patient", "employee", "person", "contact", "dob", "birth",
]
FUNCTION_RISKY_CONTEXT_WORDS = [
    "social security", "ssn", "identity", "date of birth", "dob", "confidential", "medical",
]

# legacy profile (the older function engine): function patterns and words,
# a "**/**/" date mask and its own quality wording / keyword list
LEGACY_NONNEG_WORDS = ["revenue", "amount", "price", "quantity", "qty", "score"]
LEGACY_CHECKS = {
    "not_null": ("not null", "{n} null value(s)"),
    "email": ("email format", "{n} invalid email(s)"),
    "age": ("age range 0-120", "{n} out-of-range age(s)"),
    "nonneg": ("non-negative ({col})", "{n} negative value(s)"),
}

# shared
EMAIL_COLUMNS = ["email", "email_address", "contact_email", "user_email"]

# context confidence values and risk thresholds
CONF_SAFE_WITH_CONTEXT = 0.75
CONF_SAFE = 0.15
CONF_RISKY_COLUMN = 1.0
CONF_CONTEXT = 0.90
CONF_DEFAULT = 0.50
RISK_HIGH_AT = 0.75
RISK_MEDIUM_AT = 0.40

# mask patterns (what the mask replaces, from the start of the value)
MASK_SSN_REGEX = r"^\d{3}-\d{2}-"
MASK_CARD_REGEX = r"[^\d]"
MASK_PHONE_REGEX = r"^\+?1?[\-.\s]?\(?\d{3}\)?[\-.\s]\d{3}"
MASK_DOB_REGEX = r"^\d{1,2}[\/\-]\d{1,2}[\/\-]"

# mask texts
MASK_SSN_PREFIX = "XXX-XX-"
MASK_CARD_PREFIX = "XXXX-XXXX-XXXX-"
MASK_CARD_NO_DIGITS = "XXXX-XXXX-XXXX-XXXX"
MASK_PHONE_PREFIX = "XXX-XXX"
MASK_EMAIL_BAD = "***@***"
MASK_PASSPORT_SUFFIX = "****"
MASK_BULLET = "•"
CLI_DOB_PREFIX = "**/**/"
FUNCTION_DOB_PREFIX = "**/*/"

# reason texts (format with the column name)
REASON_SAFE = "Pattern in likely-safe column '{col}' — verify manually"
REASON_RISKY = "High-risk column name '{col}'"
REASON_FREE = "Pattern in free-text column '{col}'"

# column-name rules of the quality suite
ID_COLUMN_REGEX = r"(?i)\bid\b|_id$|^id_"
EMAIL_FORMAT_REGEX = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ZIP_COLUMN_REGEX = r"(?i)zip|postal"
ZIP_FORMAT_REGEX = r"^\d{5}(-\d{4})?$"
CLI_NONNEG_WORDS = ["revenue", "amount", "price", "quantity", "qty", "count", "score"]
FUNCTION_NONNEG_WORDS = ["revenue", "amount", "price", "quantity", "qty"]
FORMAT_MOSTLY = 0.95

# drift: keywords that make a newly added column CRITICAL
CRITICAL_COLUMN_WORDS = [
    "password", "passwd", "secret", "token", "api_key", "apikey",
    "medical", "diagnosis", "health", "prescription", "treatment",
    "salary", "compensation", "wage", "income",
    "credit_card", "card_number", "cvv", "ssn", "sin",
    "race", "ethnicity", "religion", "political", "biometric",
]

# grades
GRADES = [
    (85, "A — Healthy"),
    (70, "B — Acceptable"),
    (55, "C — Needs attention"),
    (40, "D — At risk"),
]
GRADE_FLOOR = "F — Critical"

# pandas' default NA tokens for read_csv (public pandas documentation)
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

RISK_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


@dataclass(frozen=True)
class Profile:
    name: str
    patterns: tuple
    sensitivity: dict
    safe_col_words: tuple
    risky_col_words: tuple
    risky_context_words: tuple
    email_columns: tuple = tuple(EMAIL_COLUMNS)
    dob_mask_prefix: str = CLI_DOB_PREFIX
    pad_fallback_mask: bool = True          # 2 chars + max(4, len-2) bullets vs 2 chars + 4
    strict_quality: bool = False            # function-style checks instead of the suite
    legacy_quality: bool = False            # older wording, checks grouped by kind
    pack_penalty: bool = True
    near_duplicates: bool = True
    with_reason: bool = True
    nonneg_words: tuple = tuple(CLI_NONNEG_WORDS)
    match: str = "substring"                # or "token"
    extra: dict = field(default_factory=dict)

    def level(self, sensitivity: str | None) -> str:
        """B1 whitelist: an unknown sensitivity level means medium."""
        return sensitivity if sensitivity in self.sensitivity else "medium"

    def active_types(self, sensitivity: str | None) -> list[str]:
        """Types enabled at ``sensitivity`` (unknown level -> medium), in pattern order."""
        level = self.sensitivity.get((sensitivity or "medium"), self.sensitivity["medium"])
        return [t for t, _ in self.patterns if t in level]

    def pattern(self, pii_type: str) -> str:
        return dict(self.patterns)[pii_type]

    def with_options(self, **kw) -> "Profile":
        return replace(self, **kw)


CLI = Profile(
    name="cli",
    patterns=tuple(PATTERNS_ALL),
    sensitivity=CLI_SENSITIVITY,
    safe_col_words=tuple(CLI_SAFE_COL_WORDS),
    risky_col_words=tuple(CLI_RISKY_COL_WORDS),
    risky_context_words=tuple(CLI_RISKY_CONTEXT_WORDS),
)

FUNCTION = Profile(
    name="function",
    patterns=tuple((t, p) for t, p in PATTERNS_ALL if t in FUNCTION_TYPES),
    sensitivity=FUNCTION_SENSITIVITY,
    safe_col_words=tuple(FUNCTION_SAFE_COL_WORDS),
    risky_col_words=tuple(FUNCTION_RISKY_COL_WORDS),
    risky_context_words=tuple(FUNCTION_RISKY_CONTEXT_WORDS),
    dob_mask_prefix=FUNCTION_DOB_PREFIX,
    pad_fallback_mask=False,
    strict_quality=True,
    pack_penalty=False,
    near_duplicates=False,
    with_reason=False,
    nonneg_words=tuple(FUNCTION_NONNEG_WORDS),
)

LEGACY = FUNCTION.with_options(name="legacy", dob_mask_prefix=CLI_DOB_PREFIX, legacy_quality=True,
                               nonneg_words=tuple(LEGACY_NONNEG_WORDS))

PROFILES = {"cli": CLI, "function": FUNCTION, "legacy": LEGACY}


def get_profile(profile: "str | Profile") -> Profile:
    if isinstance(profile, Profile):
        return profile
    return PROFILES[profile]
