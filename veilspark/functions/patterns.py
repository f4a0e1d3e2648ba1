"""Patterns and word lists of the text scanner and the element classifiers."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """One kind of identifier. ``regex`` is written with ASCII ``\\b``; ``needs`` is a cheap test a text must pass first."""

    id: str
    regex: str
    confidence: float
    check: str | None = None  # luhn, verhoeff or octets
    guard: bool = False  # not within a longer run of digits
    ignore_case: bool = False
    needs: str = "digit"  # digit, @ or +


# The kinds of identifiers in scan order, with pattern and confidence.
PATTERNS = (
    Pattern("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95, needs="@"),
    Pattern("aadhaar", r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b", 0.9, check="verhoeff", guard=True),
    Pattern("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.95),
    Pattern("upi", r"\b[\w.\-]{2,}@(?:ok(?:icici|hdfcbank|axis|sbi)|paytm|ybl|upi|apl|axl|ibl)\b", 0.95, ignore_case=True, needs="@"),
    Pattern("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.9),
    Pattern("credit-card", r"\b(?:\d[ -]?){13,19}\b", 0.95, check="luhn"),
    Pattern("phone-in", r"(?:\+91[ -]?)?\b[6-9]\d{9}\b", 0.85, guard=True),
    Pattern("phone-intl", r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}\b", 0.8, needs="+"),
    Pattern("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.95, guard=True),
    Pattern("passport-in", r"\b[A-PR-WY][0-9]{7}\b", 0.75),
    Pattern("ip-address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6, check="octets"),
)
# Autocomplete tokens of sensitive fields; the first in this order wins.
AUTOCOMPLETE_TOKENS = (
    "cc-number", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-csc", "cc-name", "cc-type",
    "current-password", "new-password", "one-time-code",
    "email", "tel", "tel-national", "tel-local", "tel-area-code",
    "name", "given-name", "family-name", "additional-name", "nickname", "username",
    "street-address", "address-line1", "address-line2", "address-line3",
    "address-level1", "address-level2", "postal-code", "country", "country-name",
    "bday", "bday-day", "bday-month", "bday-year", "sex",
)
# Name patterns of sensitive fields, in order of preference.
NAME_PATTERNS = (
    "pass(word|wd|phrase)?", "secret", "token", "api.?key", "auth", "ssn", "social.?security", "aadhaa?r", "uidai",
    r"pan\b", "pan.?(no|num|card)", "passport", "licen[cs]e", "voter.?id", "driving",
    "credit", "debit", "card.?(no|num|number)", "cvv", "cvc", "csc", r"pin\b", "otp", "mfa", "2fa",
    "email", "e-mail", "mail.?id", "phone", "mobile", "contact.?(no|num)", "whatsapp", "dob", "birth", r"age\b",
    "address", "street", "pincode", "postal", "zip", "salary", "income", r"ctc\b",
    "account.?(no|num|number)", "acct", "ifsc", "swift", "iban", "upi", r"vpa\b", "gst(in)?", r"tin\b",
    "medical", "health", "insurance", "policy.?(no|num)",
)
# The shorter lists of the earlier classifier.
AUTOCOMPLETE_TOKENS_V1 = (
    "cc-number", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-csc", "cc-name",
    "email", "tel", "tel-national", "name", "given-name", "family-name",
    "street-address", "address-line1", "address-line2", "postal-code",
    "bday", "bday-day", "bday-month", "bday-year", "current-password", "new-password", "one-time-code",
)
NAME_PATTERN_V1 = r"pass(word)?|ssn|aadhar|aadhaar|passport|credit|card.?number|cvv|cvc|pin\b|otp|email|phone|mobile|dob|birth|address|salary|account.?number|ifsc|pan\b"
# Sensitive classes of a vision detector, and those that are blurred instead of covered.
SENSITIVE_CLASSES = ("person", "face", "head", "cell phone", "laptop", "tv", "book", "id card")
BLURRED_CLASSES = ("person", "face", "head")
# Stages of a frame in reporting order, and the interactive tags and roles.
STAGES = ("capture", "decode", "domScan", "preprocess", "inference", "postprocess", "merge", "composite", "encode", "scrub", "network")
INTERACTIVE_TAGS = ("button", "input", "textarea", "select")
INTERACTIVE_ROLES = ("button", "link", "textbox")

#: ``\b`` on ASCII word characters whatever the runtime's own notion of a word is.
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def jvm_regex(regex: str, ignore_case: bool = False) -> str:
    """``regex`` for Spark: ASCII boundaries spelled out."""
    return ("(?i)" if ignore_case else "") + regex.replace(r"\b", ASCII_BOUNDARY)


NAME_REGEX = "|".join(NAME_PATTERNS)
