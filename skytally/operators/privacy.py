"""Personal data by privacy regime, names that tell of it, and digests.

Patterns are applied in order; a card number must pass its check digit. In a protected field a match becomes a pseudonym instead.
All of it is Spark's own functions, but for one digest that Spark lacks.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
# Patterns of the kinds, and the kinds that each regime names, in order.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+\d{1,3}[\s\-]?\d[\d\s\-]{6,12}\d|\b\d{3}[\s\-]\d{3}[\s\-]\d{4}\b|\b\d{4}[\s\-]\d{6}\b)",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "credit_card": r"\b(?:\d[ \-]?){13,18}\d\b",
    "ipv4": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "ipv6": rf"(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}|(?:[0-9a-fA-F]{{1,4}}:){{1,7}}:|:(?::[0-9a-fA-F]{{1,4}}){{1,7}}|::(?:[fF]{{4}}:){{0,1}}{_OCTET}(?:\.{_OCTET}){{3}}",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{8,30}\b",
    "dob": r"\b(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}\b|\b\d{2}[-/]\d{2}[-/](?:19|20)\d{2}\b",
    "nhs": r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{4}\b",
    "icd10": r"\b[A-Z]\d{2}\.\d{1,4}\b",
}
REGIMES = {
    "gdpr": ("email", "phone", "ssn", "credit_card", "ipv4", "ipv6", "iban", "dob", "nhs"),
    "ccpa": ("email", "phone", "ssn", "credit_card", "ipv4", "ipv6", "iban", "dob", "nhs"),
    "hipaa": ("email", "ssn", "icd10", "nhs", "dob", "credit_card"),
}
KEY_SIGNS = {"email": r"email|e_mail", "phone": r"phone|mobile|tel\b", "ssn": r"\bssn\b|social.?security", "dob": r"\bdob\b|date.?of.?birth|birth.?date", "nhs": r"\bnhs\b"}


def luhn(number: Column) -> Column:
    """Whether the digits of a text pass the check digit."""
    digits = F.reverse(F.split(F.regexp_replace(number, r"\D", ""), ""))
    doubled = F.transform(F.array_remove(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)
    return F.filter(found, luhn) if kind == "credit_card" else found


def redacted(text: Column, regime: str = "gdpr", pseudonym: bool = False) -> Column:
    """The text with all matches of the regime's kinds replaced in order: [REDACTED_KIND], or [PSEUDO:digest] in a protected field."""
    if regime not in REGIMES:
        raise ValueError(f"no such regime: {regime}")
    pseudo = lambda t, m: F.replace(t, m, F.concat(F.lit("[PSEUDO:"), F.substring(F.sha2(m, 256), 1, 16), F.lit("]")))
    for kind in REGIMES[regime]:
        if pseudonym:
            text = F.aggregate(F.array_distinct(matches(text, kind)), text, pseudo)
        elif kind == "credit_card":
            text = F.aggregate(F.array_distinct(matches(text, kind)), text, lambda t, m: F.replace(t, m, F.lit("[REDACTED_CREDIT_CARD]")))
        else:
            text = F.regexp_replace(text, PATTERNS[kind], f"[REDACTED_{kind.upper()}]")
    return text


def signalled(columns: Sequence[str], regime: str = "gdpr") -> dict[str, str]:
    """Columns whose names tell of personal data, and of which kind; their values go as a whole."""
    import re

    return {c: k for c in columns for k in reversed(KEY_SIGNS) if k in REGIMES[regime] and re.search(KEY_SIGNS[k], c, re.I)}


def protected(rows: DataFrame, regime: str = "gdpr") -> DataFrame:
    """Text columns redacted; columns with telling names have [REDACTED] for every value that isn't blank."""
    told, texts = signalled(rows.columns, regime), {c for c, t in rows.dtypes if t == "string"}
    return rows.withColumns({c: F.when(F.trim(c) != "", F.lit("[REDACTED]")).otherwise(F.col(c)) if c in told else redacted(F.col(c), regime) for c in rows.columns if c in texts})


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of marks by kind under each regime's patterns, and a digest of the redacted text; null texts have nulls."""
    made = docs.select("doc_id", *(redacted(F.col("text"), r).alias(r) for r in ("gdpr", "hipaa")))
    count = lambda r, k: F.regexp_count(r, F.lit(rf"\[REDACTED_{k.upper()}\]")).cast("long").alias(f"{r}_{k}")
    return made.select("doc_id", *(count(r, k) for r in ("gdpr", "hipaa") for k in REGIMES[r]), *(F.md5(r).alias(f"{r}_digest") for r in ("gdpr", "hipaa")))


@F.pandas_udf(StringType())
def blake2b(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode()).hexdigest())


def keyed_blake2b(key: bytes) -> object:
    """A column function: BLAKE2b of a text under a key."""

    @F.pandas_udf(StringType())
    def hashed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), key=key[:64]).hexdigest())

    return hashed


def signature(text: str, key: bytes) -> str:
    """HMAC-SHA256 of one text, as the keyed hashes of the queries have it."""
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def digests(telemetry: DataFrame) -> DataFrame:
    """event_id and the digests of the function's name by all algorithms of the library."""
    name = F.col("function_id")
    return telemetry.select("event_id", F.md5(name).alias("md5"), F.sha1(name).alias("sha1"), F.sha2(name, 256).alias("sha256"), F.sha2(name, 512).alias("sha512"), blake2b(name).alias("blake2b"))
