r"""Pattern registry: what a typed value looks like in text.

Patterns are written once in a common notation: ``\b`` is a word boundary, ``\d`` a decimal digit,
``\s`` whitespace, all in the Unicode sense. Where a pattern has a group, the group is the value. ``java_regex`` spells the notation out with explicit classes, because what
``\b`` means to Java depends on the JDK.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from veil.functions.text import SPACE

WORD = r"[\p{L}\p{N}_]"


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    confidence: float = 0.9
    hints: tuple = ()  # literals, one of which every match contains; checked before the regex runs
    needs: str = ""  # a plain regex that every match contains; run once for all patterns that share it
    digits: bool = False  # every match contains two digits in a row
    any_digit: bool = False  # \\d covers every script's digits, not only 0-9
    source: str = "REGEX"

    @property
    def group(self) -> int:
        return 1 if re.search(r"\((?!\?)", self.regex.replace(r"\(", "")) else 0


def java_regex(regex: str, any_digit: bool = False) -> str:
    r"""Common notation -> Java.

    ``\b`` closes when nothing but closers follow it, else it opens. An opening ``\b`` tests the
    first character before it looks back, because most positions fail on the first character.
    """
    digit, space = (r"\p{Nd}" if any_digit else "0-9"), SPACE[1:-1]
    before, after = f"(?<!{WORD})", f"(?!{WORD})"
    edge = f"(?:{before}(?={WORD})|(?<={WORD}){after})"
    out = re.sub(r"\\b(?=$|\))", lambda _: after, regex)
    first = re.match(r"\\b(\\d|\[[^\]]+\]|[A-Za-z])", out)
    if first and "." in first.group(1):
        out = edge + out[2:]
    elif first:
        out = f"(?={first.group(1)}){before}" + out[2:]
    out = out.replace(r"\b", before).replace(r"(?=\w)", f"(?={WORD})")
    # inside a class only the members are spelled out, elsewhere a whole class is
    out = re.sub(
        r"\[[^\]]*\]",
        lambda m: m.group(0).replace(r"\d", digit).replace(r"\s", "\0"),
        out,
    )
    return out.replace(r"\d", f"[{digit}]").replace(r"\s", f"[{space}]").replace("\0", space)


KEY = r"(?: [Nn]umber| [Nn]o\.?| ID)?[:# ]{1,3}"

REGISTRY = [
    Pattern("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.95, digits=True),
    Pattern("CREDIT_CARD", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", 0.95, digits=True),
    Pattern("BANK_ACCOUNT", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.9, digits=True),
    Pattern("BANK_ACCOUNT", r"\b(?:[Aa]ccount|[Aa]cct|[Rr]outing)" + KEY + r"(\d{8,17})\b", 0.9, ("ccount", "cct", "outing"), digits=True),
    Pattern("AADHAAR", r"\b\d{4} \d{4} \d{4}\b", 0.85, digits=True),
    Pattern("PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.9, digits=True),
    Pattern("PASSPORT", r"\b[Pp]assport" + KEY + r"([A-Z]{0,2}\d{6,9})\b", 0.9, ("assport",), digits=True),
    Pattern("DRIVER_LICENSE", r"\b[Dd]river'?s? [Ll]icense" + KEY + r"([A-Z]{0,2}\d{5,12})\b", 0.9, ("river",), digits=True),
    Pattern("MEDICAL_RECORD", r"\bMRN[- ]?\d{6}\b", 0.95, ("MRN",), digits=True),
    Pattern("INSURANCE_ID", r"\bINS-[A-Z0-9]{2}-\d{6}-\d{4}\b", 0.95, ("INS-",), digits=True),
    Pattern("EMPLOYEE_ID", r"\bEMP-\d{4}-\d{4}\b", 0.95, ("EMP-",), digits=True),
    Pattern("STUDENT_ID", r"\b[Ss]tudent ID[:# ]{1,3}([A-Z]{0,3}-?\d{4,10})\b", 0.9, ("tudent ID",), digits=True),
    Pattern("VACCINE_LOT", r"\bVAX-[A-Z0-9]{4}-[A-Z0-9]{4}\b", 0.95, ("VAX-",)),
    Pattern("TRACKING_NUMBER", r"\bTRK-\d{10}\b", 0.95, ("TRK-",), digits=True),
    Pattern("RECEIPT_NUMBER", r"\bRN-\d{4}-\d{6}\b", 0.95, ("RN-",), digits=True),
    Pattern("VOLUNTEER_CODE", r"\bVOL-[A-Z0-9]{2}-\d{3}\b", 0.95, ("VOL-",), digits=True),
    Pattern("BARCODE", r"\b[Bb]arcode[:# ]{1,3}(\d{12,})\b", 0.9, ("arcode",), digits=True),
    Pattern("VEHICLE_PLATE", r"\b[A-Z]{2}[- ]\d{2}[- ][A-Z]{1,2}[- ]\d{4}\b", 0.85, digits=True),
    Pattern("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", 0.95, (":",)),
    Pattern("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.9),
    Pattern("URL", r"https?://[^\s\"<>]+", 0.95, ("://",)),
    Pattern("COORDINATES", r"-?\d{1,3}\.\d{3,}, ?-?\d{1,3}\.\d{3,}", 0.85, digits=True),
    Pattern("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95, ("@",)),
    Pattern("PHONE", r"\+?1?[-. ]?\(\d{3}\)[-. ]?\d{3}[-. ]?\d{4}\b", 0.9, ("(",), digits=True),
    Pattern("PHONE", r"\b\d{3}[-.]\d{3}[-.]\d{4}\b", 0.9, digits=True),
    Pattern("DATE_OF_BIRTH", r"\b(?:DOB|[Bb]orn on|[Bb]orn|[Dd]ate of [Bb]irth)[:# ]{1,3}(\d{1,2}/\d{1,2}/\d{4})\b", 0.9, digits=True),
    Pattern("DATE", r"\b\d{1,2}/\d{1,2}/\d{4}\b", 0.85, digits=True),
    Pattern("ADDRESS", r"\b\d{1,5} [A-Z][a-z]+(?: [A-Z][a-z]+)* (?:Street|Avenue|Road|Boulevard|Drive|Lane|Way|Court)\b", 0.85, ("Street", "Avenue", "Road", "Boulevard", "Drive", "Lane", "Way", "Court")),
    Pattern("ZIP_CODE", r"\b[A-Z]{2} (\d{5}(?:-\d{4})?)\b", 0.8, digits=True),
    Pattern("PERSON", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", 0.6),
    Pattern("ORG", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)* (?:Inc|LLC|Corp|Corporation|Company|Ltd|Limited|GmbH)\b", 0.7, ("Inc", "LLC", "Corp", "Company", "Ltd", "Limited", "GmbH")),
    Pattern("LOC", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*, [A-Z]{2} \d{5}\b", 0.7, digits=True),
]

# A custom rule is one more row.
SECRET = Pattern("SECRET", r"\btoken = \"([0-9a-f]{8,})", 0.95, ("token = ",))

# --- fixed values: numeric patterns, tried in this order ---
THOUSANDS = r"\d,\d\d\d"
NUMERIC = [
    Pattern("numerical", r"\$[\d,]+\.?\d*", hints=("$",), any_digit=True),
    Pattern("numerical", r"\b\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?\b", hints=(",",), needs=THOUSANDS, any_digit=True),
    Pattern("numerical", r"\b\d+\.\d{1,2}\b", hints=(".",), needs=r"\d\.\d", any_digit=True),
    Pattern("numerical", r"\b\d{2,}\b", needs=r"\d\d", any_digit=True),
    Pattern("numerical", r"\b\d{1,2}(?:,\d{3})+(?:\.\d{1,2})?\b", hints=(",",), needs=THOUSANDS, any_digit=True),
]

# --- fixed values: proper-noun patterns, tried in this order ---
STREET = (
    "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Place|Pl|Court|Ct|Circle|"
    "Cir|Square|Sq|Park|Pkwy|Highway|Hwy|Freeway|Fwy"
)
CAPITALS, INITIAL = r"[A-Z][a-z]+\s+[A-Z]", r"[A-Z]\.\s*[A-Z]"
HOUSE, ZIP = r"\d\s+[A-Z]", r"[A-Z][A-Z]\s*\d{5}"
NOUNS = [
    Pattern("name", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", needs=CAPITALS, any_digit=True),
    Pattern("name", r"\b[A-Z][a-z]+\s+[A-Z]\.\s*[A-Z][a-z]+\b", hints=(".",), needs=INITIAL, any_digit=True),
    Pattern("name", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b", needs=CAPITALS, any_digit=True),
    Pattern("name", r"\b[A-Z][a-z]+-[A-Z][a-z]+\s+[A-Z][a-z]+\b", hints=("-",), needs=r"[a-z]-[A-Z]", any_digit=True),
    Pattern("name", r"\b[A-Z]\.\s*[A-Z][a-z]+\b", hints=(".",), needs=INITIAL, any_digit=True),
    Pattern("name", r"\b[A-Z][a-z]+\s+[A-Z]\.\s*[A-Z]\.(?=\w)", hints=(".",), needs=INITIAL, any_digit=True),
    Pattern("address", rf"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:{STREET})\b", needs=HOUSE, any_digit=True),
    Pattern("address", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?\b", hints=(",",), needs=ZIP, any_digit=True),
    Pattern("address", rf"\b\d{{1,5}}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:{STREET})\b", needs=HOUSE, any_digit=True),
    Pattern("address", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+[A-Z]{2}\s*\d{5}\b", needs=ZIP, any_digit=True),
    Pattern("organization", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|LLC|Corp|Corporation|Company|Co|Ltd|Limited|GmbH|AG|SA|SAS)\b", hints=("Inc", "LLC", "Co", "Ltd", "Limited", "GmbH", "AG", "SA"), needs=CAPITALS, any_digit=True),
    Pattern("organization", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Bank|Insurance|Financial|Trust|Credit|Union|Savings)\b", hints=("Bank", "Insurance", "Financial", "Trust", "Credit", "Union", "Savings"), needs=CAPITALS, any_digit=True),
]

# --- fixed values: fallback substitutions, applied in this order ---
FALLBACK = [
    (r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "John Smith"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "123-45-6789"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "555-123-4567"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "example@email.com"),
    (r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?", "$1,234.56"),
    (r"\b\d{1,5}\s+[A-Z][a-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd)\b", "123 Main Street"),
]
