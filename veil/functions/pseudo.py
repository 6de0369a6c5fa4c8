"""Stand-ins for original values, as SQL text over columns or lambda variables."""

from __future__ import annotations

from veil.functions import hashing as H
from veil.functions.spans import let
from veil.functions.text import SPACE

# --- fixed values: words that tell what kind of place a text names ---
STREET_WORDS = "street|road|lane|avenue|drive"
CITY_WORDS = "city|town|ville"
UNIT_WORDS = "apartment|apt|suite|floor"
DIGIT_TYPES = ["PHONE", "CREDIT_CARD", "SSN", "BANK_ACCOUNT"]


def squeezed(text: str) -> str:
    """Trimmed, with single blanks between words."""
    return f"regexp_replace(regexp_replace({text}, r'{SPACE}+', ' '), '^ | $', '')"


def stars(text: str) -> str:
    return f"repeat('*', length({text}))"


def place(text: str, salt: str = "") -> str:
    low = f"lower({text})"
    return f"""CASE WHEN rlike({low}, '{STREET_WORDS}') THEN {H.pick(H.ADDRESSES, text, salt)}
        WHEN rlike({low}, '{CITY_WORDS}') THEN {H.pick(H.CITIES, text, salt)}
        WHEN rlike({low}, '{UNIT_WORDS}') THEN {H.pick(H.APT_TYPES, text, salt)}
        ELSE {H.pick(H.LOCATIONS, text, salt)} END"""


def person(text: str, salt: str = "") -> str:
    """Part by part: the same name part always becomes the same stand-in part.

    The last of exactly two parts draws from the last names, every other part from the first names.
    """
    body = f"""array_join(transform(parts, (part, i) -> IF(size(parts) = 2 AND i = 1,
        {H.pick(H.LAST_NAMES, 'part', salt)}, {H.pick(H.FIRST_NAMES, 'part', salt)})), ' ')"""
    return let(f"split({squeezed(text)}, ' ')", "parts", body)


def pseudonym(pii_type: str, text: str, salt: str = "") -> str:
    digit_types = ", ".join(f"'{t}'" for t in DIGIT_TYPES)
    return f"""CASE WHEN {pii_type} = 'PERSON' THEN {person(text, salt)}
        WHEN {pii_type} IN ('LOC', 'ADDRESS') THEN {place(text, salt)}
        WHEN {pii_type} = 'ORG' THEN {H.pick(H.ORGANIZATIONS, text, salt)}
        WHEN {pii_type} IN ({digit_types}) THEN {H.replace_digits(text, salt)}
        ELSE {H.pick(H.MISC_LABELS, text, salt)} END"""


def replacement(strategy: str, pii_type: str, text: str, given: str | None = None, salt: str = "", custom: dict | None = None) -> str:
    """What a plan row puts in place of its text.

    ``given`` names a column whose non-empty value wins for ``pseudo``. ``custom`` maps further
    strategy names to functions from SQL text to SQL text.
    """
    drawn = pseudonym(pii_type, text, salt)
    pseudo = f"coalesce(nullif({given}, ''), {drawn})" if given else drawn
    more = " ".join(f"WHEN '{name}' THEN {fn(text)}" for name, fn in (custom or {}).items())
    return f"""CASE {strategy} WHEN 'redact' THEN '[REDACTED]' WHEN 'mask' THEN {stars(text)}
        WHEN 'pseudo' THEN {pseudo} {more} ELSE '[UNKNOWN_STRATEGY]' END"""


def mask_named(text: str, strategy: str, pii_type: str, salt: str = "") -> str:
    """The direct-edit variant: names keep their word structure, an unknown strategy changes nothing."""
    name = squeezed(text)
    return f"""CASE lower({strategy})
        WHEN 'mask' THEN IF({pii_type} = 'PERSON' AND contains({name}, ' '), regexp_replace({name}, '[^ ]', '*'), {stars(text)})
        WHEN 'redact' THEN '[REDACTED]'
        WHEN 'pseudo' THEN {pseudonym(pii_type, text, salt)}
        ELSE {text} END"""


def synth_by_subtype(subtype: str, value: str, unique: bool = False, salt: str = "") -> str:
    """A value of the column's subtype that depends on the original only.

    ``unique`` carries 96 more digest bits in every subtype, so that distinct keys of a large table stay
    distinct and joins on any of them keep their row counts.
    """
    # written out rather than bound: outside lambdas the generated code computes the digest once
    h = H.digest(value, salt)
    num = f"translate({h}, 'abcdef', '012345')"

    def part(start: int) -> str:
        return f"CAST(conv(substr({h}, {start}, 8), 16, 10) AS BIGINT)"

    def digits(start: int, n: int) -> str:
        return f"substr({num}, {start}, {n})"

    first, last = H.choose(H.FIRST_NAMES, part(1)), H.choose(H.LAST_NAMES, part(9))
    tail = f"concat('-', substr({h}, 9, 24))" if unique else "''"
    mail = f"concat('.', substr({h}, 9, 24))" if unique else "''"
    call = f"concat(' x', substr({num}, 9, 32))" if unique else "''"
    letters = f"upper(translate(substr({h}, 17, 4), '0123456789', 'ghjkmnpqrs'))"
    body = f"""CASE WHEN {subtype} = 'name' THEN concat({first}, ' ', {last}, {tail})
        WHEN {subtype} = 'email' THEN concat(lower({first}), '.', lower({last}), {digits(17, 4)}, {mail}, '@example.com')
        WHEN {subtype} IN ('phone', 'phone_number') THEN concat('555-', {digits(1, 3)}, '-', {digits(4, 4)}, {call})
        WHEN {subtype} IN ('ssn', 'national_id') THEN concat({digits(1, 3)}, '-', {digits(4, 2)}, '-', {digits(6, 4)}, {tail})
        WHEN {subtype} = 'address' THEN concat({H.choose(H.ADDRESSES, part(1))}, ', ', {H.choose(H.CITIES, part(9))}, {tail})
        WHEN {subtype} IN ('date_of_birth', 'date') THEN concat(CAST(date_add(DATE'1940-01-01', CAST({part(1)} % 25000 AS INT)) AS STRING), {tail})
        WHEN {subtype} IN ('medical_record_number', 'medical_condition') THEN concat('MRN-', {letters}, '-', {digits(1, 5)}, {tail})
        WHEN {subtype} IN ('generic_id', 'id', 'account_number') THEN concat('ACC-', {digits(1, 8)}, {tail})
        ELSE concat({H.choose(H.WORDS, part(1))}, '_anon', {tail}) END"""
    return f"IF({value} IS NULL, NULL, {body})"


def perturb_number(value: str, salt: str = "") -> str:
    """Base times a factor in [0.8, 1.2) from the value's hash, in the original's format."""
    base = f"try_cast(translate({value}, '$,', '') AS DOUBLE)"
    moved = f"{base} * (0.8D + 0.4D * {H.hash_int(value, salt)} / 4294967296.0D)"
    body = f"""CASE WHEN m IS NULL THEN {stars(value)}
        WHEN contains({value}, '$') THEN concat('$', format_number(m, 2))
        WHEN contains({value}, '.') THEN format_string('%.2f', m)
        ELSE format_number(floor(m), 0) END"""
    return let(moved, "m", body)


def replace_noun(item_type: str, value: str, salt: str = "") -> str:
    """Names and addresses get stand-ins, organizations are starred out."""
    return f"""CASE {item_type}
        WHEN 'name' THEN concat({H.pick(H.FIRST_NAMES, value, salt)}, ' ', {H.pick(H.LAST_NAMES, value, salt, 9)})
        WHEN 'address' THEN {H.pick(H.ADDRESSES, value, salt)}
        ELSE {stars(value)} END"""
