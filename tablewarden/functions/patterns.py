"""Name and text patterns. All values here are fixed: results depend on them exactly."""

# Column names that mark an identifier.
IDENTIFIER_NAME = (
    "(^id$|_id$|^id_|_id_|^uuid$|^guid$|^record_id$|^customer_id$|^transaction_id$)"
)
POTENTIAL_IDENTIFIER_NAME = "(code|key|token|reference|account)"

# Personal data, in the order in which a column is classified.
PII_PATTERNS = {
    "Email Addresses": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "Phone Numbers": r"\b[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "Social Security Numbers": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "Credit Card Numbers": (
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"
    ),
}

# Whole-value personal data, for the dictionary warning.
PII_WHOLE_VALUES = [
    r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    r"^\+?1?\s*\(?-*\.*([0-9]{3})\)?\.*-*\s*([0-9]{3})\.*-*\s*([0-9]{4})$",
]

# A value that is digits with at most one dot.
NUMBER_LIKE = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"

# Text that a number parser accepts in full (no type suffixes).
PARSABLE_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Target column names.
TARGET_NAMES = ["target", "label", "class", "outcome", "status", "price", "churn", "survived"]
TARGET_EXACT_ONLY = ["y"]

# Names whose gaps are better filled with a median.
MEDIAN_NAMES = ["age", "price", "amount"]

JUNK_PREFIX = "Unnamed:"
