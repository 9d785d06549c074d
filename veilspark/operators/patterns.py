"""Catalogue of sensitive-data patterns, their placeholders, and which of them each level redacts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    ord: int
    type: str
    placeholder: str
    regex: str  # Python spelling; matched without regard to case
    low: str  # the same matches on a text in ASCII that was lowered, in a form that begins with a rare sign, so that the search for it is quick
    back: int = 0  # how many signs before that form's match the pattern's match begins

    def spans(self, low: str, regex: re.Pattern) -> list[tuple[int, int]]:
        """Where the pattern matches in a lowered text in ASCII; ``regex``: ``low``, compiled."""
        if self.type != "EMAIL":
            return [(m.start() - self.back, m.end()) for m in regex.finditer(low)] if self.back else [m.span() for m in regex.finditer(low)]
        out, reach = [], 0
        for m in regex.finditer(low):  # from the @ on; what stands before it begins where its signs do, behind the match before
            head = low[reach : m.start()]
            if n := len(head) - len(head.rstrip(_LOCAL)):
                reach = m.end()
                out.append((m.start() - n, reach))
        return out

    @property
    def java(self) -> str:
        """For Spark's own functions: Unicode classes, as Python has them."""
        return "(?iU)" + self.regex

    @property
    def ascii(self) -> str:
        """For Spark's own functions on texts in ASCII: the same matches for less."""
        return "(?i)" + self.regex

    def may_match(self, text: Column) -> Column:
        """False only for texts in which the pattern can't match, as they lack a sign that it needs; found in a fraction of the pattern's own time."""
        return F.contains(text, F.lit("@")) if self.type == "EMAIL" else text.rlike(_NEEDS.get(self.type, r"(?U)\d"))

    @property
    def re2(self) -> str:
        """For DuckDB."""
        return "(?i)" + self.regex.replace(r"\u00A0", r"\x{00A0}")


_LOCAL = "abcdefghijklmnopqrstuvwxyz0123456789._%+-"  # of an address, before the @

# What the patterns without a digit need; dotted and dotless i match each other without regard to case.
_NEEDS = {"NATIONAL_ID": "(?iU)[iıİ]d", "BIOMETRIC": "(?iU)[fiıİb](?:ace|[iıİ]nger|r[iıİ]s|[iıİ]ometr[iıİ]c)"}

# Types, placeholders and expressions, in the order in which ties are broken.
PATTERNS = [
    Pattern(0, "EMAIL", "[EMAIL]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"@(?<=[a-z0-9._%+-]@)[a-z0-9.-]+\.[a-z]{2,}"),
    Pattern(1, "PHONE_EU", "[PHONE]", r"(?:\+\d{1,3}\s?)?(?:\d[\s-]?){9,}", r"[+\d](?:(?<=\+)\d{1,3}\s?(?:\d[\s-]?){9,}|(?<=\d)[\s-]?(?:\d[\s-]?){8,})"),
    Pattern(2, "SSN_LIKE", "[SSN]", r"\b\d{6}[- ]?\d{2,4}[\.]?\d{0,2}\b", r"\d(?<!\w\d)\d{5}[- ]?\d{2,4}[\.]?\d{0,2}\b"),
    Pattern(3, "IBAN", "[IBAN]", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", r"[a-z](?<!\w[a-z])[a-z]\d{2}[a-z0-9]{11,30}\b"),
    Pattern(4, "ACCOUNT_NUM", "[ACCOUNT_NUMBER]", r"\b(?:acct|account)\s*\d{3,}\b", r"acc(?<!\wacc)(?:t|ount)\s*\d{3,}\b"),
    Pattern(5, "AMOUNT", "[AMOUNT]", r"(?:USD|EUR|GBP|€|\$|£)\s?\d{1,3}(?:[, \u00A0]\d{3})*(?:\.\d{2})?", r"(?:usd|eur|gbp|\$)\s?\d{1,3}(?:[, ]\d{3})*(?:\.\d{2})?"),
    Pattern(6, "DOB", "[DATE_OF_BIRTH]", r"\b\d{4}-\d{2}-\d{2}\b", r"-\d{2}-(?<=\b\d{4}-\d{2}-)\d{2}\b", 4),
    Pattern(7, "NATIONAL_ID", "[NATIONAL_ID]", r"\bID[:\s-]?[A-Z0-9]{6,}\b", r"id(?<!\wid)[:\s-]?[a-z0-9]{6,}\b"),
    Pattern(8, "BIOMETRIC", "[BIOMETRIC_DATA]", r"\b(FaceID|fingerprint|iris|biometric)\b", r"(?:faceid|fingerprint|iris|biometric)(?<!\wfaceid)(?<!\wfingerprint)(?<!\wiris)(?<!\wbiometric)\b"),
]
BY_TYPE = {p.type: p for p in PATTERNS}


def placeholder_of(kind: str) -> str:
    """A type's placeholder; for one that the catalogue doesn't know its name in brackets."""
    return BY_TYPE[kind].placeholder if kind in BY_TYPE else f"[{kind}]"


# What each level redacts; a null level, like C4, redacts all.
LEVELS = {
    "C1": [],
    "C2": ["EMAIL", "PHONE_EU"],
    "C3": ["EMAIL", "PHONE_EU", "IBAN", "ACCOUNT_NUM", "AMOUNT"],
    "C4": [p.type for p in PATTERNS],
}

# What the levels stand for, in a catalogue and as the explanation of a classification.
LEVEL_NAMES = {
    "C1": "Public (reports, press)",
    "C2": "Internal (policies, SOPs)",
    "C3": "Confidential (transactions)",
    "C4": "Highly Sensitive (PII, financial)",
}
EXPLANATIONS = {
    "C1": "📄 Public information suitable for external sharing",
    "C2": "🏢 Internal use only - policies and procedures",
    "C3": "🔐 Confidential - business transactions",
    "C4": "⚠️ Highly Sensitive - contains PII or financial data",
}


def types_of_level(level: str | None) -> list[str]:
    return LEVELS.get(level or "C4", LEVELS["C4"])


def compiled(types: list[str] | None = None) -> list[tuple[Pattern, re.Pattern, re.Pattern]]:
    """Patterns with both compiled forms in the order of ``types`` (all, if None); unknown names are left out. Their place is their tie order."""
    names = [p.type for p in PATTERNS] if types is None else types
    return [(BY_TYPE[t], re.compile(BY_TYPE[t].regex, re.IGNORECASE), re.compile(BY_TYPE[t].low)) for t in names if t in BY_TYPE]


def may_match(text: Column) -> Column:
    """False only for texts in which no pattern can match: without a digit, an @, ``id`` or a biometric word."""
    return text.rlike(r"(?iU)\d|@|[iıİ]d|face|finger|[iıİ]r[iıİ]s|b[iıİ]ometr[iıİ]c")
