"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.split()/strip() treat as whitespace; valid in Java and RE2 classes alike.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
# the members of SPACE one by one
SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda argument is bound, so the optimizer cannot copy an expensive expression into it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """Collapse whitespace, trim, drop control characters."""
    return F.regexp_replace(collapse_space(text), r"[\x00-\x1f]", "")


def stars(text: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(text))


def partial_mask(text: Column, mask_char: str = "*", visible: int = 4) -> Column:
    """Keep the first and last few characters, mask what lies between."""
    head, tail = visible // 2, visible - visible // 2
    n = F.length(text)
    ends = F.substring(text, -tail, tail) if tail else F.lit("")
    return F.when(n <= visible, F.repeat(F.lit(mask_char), n)).otherwise(
        F.concat(F.substring(text, 1, head), F.repeat(F.lit(mask_char), n - visible), ends)
    )


# --- fixed values: accepted upload extensions and their content types ---
ALLOWED_EXTENSIONS = ["txt", "pdf", "doc", "docx", "xlsx", "csv", "json", "xml"]
SIMPLE_EXTENSIONS = ["pdf", "docx", "txt"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "txt": "text/plain",
    "csv": "text/csv",
    "json": "application/json",
    "xml": "text/xml",
    "html": "text/html",
    "md": "text/markdown",
}
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def file_extension(name: Column) -> Column:
    """Lower-case text after the last dot, null without a dot."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def file_error(name: Column, size: Column | None = None, simple: bool = False) -> Column:
    """Why an upload is rejected; null means it is accepted."""
    allowed = SIMPLE_EXTENSIONS if simple else ALLOWED_EXTENSIONS
    ext = file_extension(name)
    out = (
        F.when(name.isNull() | (name == ""), F.lit("No file provided"))
        .when(ext.isNull(), F.lit("File must have an extension"))
        .when(~ext.isin(allowed), F.concat(F.lit("File type '"), ext, F.lit("' not allowed")))
    )
    if size is not None:
        out = out.when(size > MAX_UPLOAD_BYTES, F.lit("File exceeds the upload limit"))
    return out


def content_type(name: Column) -> Column:
    from veil.functions.dims import case_lookup

    return case_lookup(file_extension(name), CONTENT_TYPES, F.lit("application/octet-stream"))


def human_size(size: Column) -> Column:
    """Bytes as ``12.3 KB``; half-way cases round to even, as C and Python print them."""
    out = F.when(size == 0, F.lit("0 B"))
    for i, unit in enumerate(SIZE_UNITS):
        shown = F.format_string(f"%.1f {unit}", F.bround(size / F.lit(1024.0**i), 1))
        last = i == len(SIZE_UNITS) - 1
        out = out.otherwise(shown) if last else out.when(size < 1024 ** (i + 1), shown)
    return out


def llm_json_text(response: Column) -> Column:
    """Strip one code fence around a model response."""
    bare = strip(response)
    opened = F.regexp_replace(bare, r"^```(?:json)?", "")
    return strip(F.regexp_replace(opened, r"```$", ""))


def json_bounds(response: Column) -> Column:
    """The JSON inside a chatty response: the first fenced block, else first bracket to last bracket."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?(.*?)```", 1)
    bounded = F.regexp_extract(response, r"(?s)([\[{].*[\]}])", 1)
    return strip(F.when(fenced != "", fenced).otherwise(bounded))


def normalize_label(label: Column) -> Column:
    """First alternative of a piped label, upper-cased, NONE when unknown or missing."""
    clean = F.upper(strip(F.substring_index(label, "|", 1)))
    plain = F.upper(label)
    value = F.when(label.contains("|"), clean).otherwise(plain)
    return F.when(value.isin("PII", "PHI", "NONE"), value).otherwise(F.lit("NONE"))


def normalize_subtype(subtype: Column) -> Column:
    return F.when(subtype.isNull() | (subtype == "null"), F.lit("other")).otherwise(subtype)


# --- fixed values: replacement ladder for "[REDACTED]" by length of the original ---
REDACT_LADDER = [(2, "**"), (4, "[*]"), (6, "[RED]"), (8, "[REDACT]")]


def fit_replacement(original: Column, replacement: Column) -> Column:
    """Shorten a replacement so that it takes no more room than the original."""
    n = F.length(strip(original))
    first = F.split_part(replacement, F.lit(" "), F.lit(1))
    last = F.split_part(replacement, F.lit(" "), F.lit(2))
    spaces = F.length(replacement) - F.length(F.replace(replacement, F.lit(" "), F.lit("")))

    ladder = None
    for limit, short in REDACT_LADDER:
        ladder = (F.when if ladder is None else ladder.when)(n <= limit, F.lit(short))
    ladder = ladder.otherwise(F.lit("[REDACTED]"))

    def cut(c: Column, k: int) -> Column:
        return F.substring(c, 1, k)

    two_words = (
        F.when(n <= 4, cut(first, 3))
        .when((n <= 6) & (F.length(first) <= 4), F.concat_ws(" ", first, cut(last, 1)))
        .when(n <= 6, cut(first, 4))
        .when(n <= 10, F.concat_ws(" ", cut(first, 4), cut(last, 4)))
        .otherwise(F.concat_ws(" ", cut(first, 5), cut(last, 6)))
    )
    one_word = (
        F.when(n <= 3, cut(replacement, 3))
        .when(n <= 5, cut(replacement, 4))
        .when(n <= 8, cut(replacement, 6))
        .otherwise(cut(replacement, 8))
    )
    room = F.greatest(n, F.lit(4))
    other = (
        F.when(F.length(replacement) <= room, replacement)
        .when(room > 6, F.concat(F.substr(replacement, F.lit(1), room - 2), F.lit("..")))
        .otherwise(F.substr(replacement, F.lit(1), room))
    )
    return (
        F.when(F.length(replacement) <= n, replacement)
        .when(replacement == "[REDACTED]", ladder)
        .when((spaces == 1) & (first != "") & (last != ""), two_words)
        .when(spaces == 0, one_word)
        .otherwise(other)
    )
