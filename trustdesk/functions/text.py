"""Column helpers for text, JSON lists, contacts and placeholders. All stay JVM-side."""

from pyspark.sql import Column, functions as F

from trustdesk.schemas import EMAIL_PATTERN, PLACEHOLDERS, UUID_PATTERN

# fixed value: NUL..BS, VT, FF, SO..US, DEL and the Unicode replacement character; tab, LF and CR survive
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F�]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize(c) -> Column:
    """Remove control characters and U+FFFD."""
    return F.regexp_replace(col(c), CONTROL_CHARS, "")


def clean_text(c, tested=None, fold=None) -> Column:
    """Trimmed text, NULL when it is a placeholder.

    ``tested`` is the column the placeholder test runs on (default: ``c`` itself); ``fold`` is
    ``F.lower`` or ``F.upper`` for columns stored in one case.
    """
    value = F.trim(col(c))
    tested = value if tested is None else F.trim(col(tested))
    return F.when(~F.lower(tested).isin(PLACEHOLDERS), fold(value) if fold else value)


def is_missing(c, extra=()) -> Column:
    """NULL, blank or the text ``null``; ``extra`` adds more spellings such as ``[]``."""
    return col(c).isNull() | F.trim(col(c)).isin(["", "null", *extra])


def is_uuid(c) -> Column:
    return col(c).rlike(UUID_PATTERN)


def email_key(c) -> Column:
    return F.lower(F.trim(col(c)))


def is_email(c) -> Column:
    return col(c).rlike(EMAIL_PATTERN)


def valid_email(c) -> Column:
    """Lower-cased address when well formed, else NULL."""
    return F.when(is_email(email_key(c)), email_key(c))


def digits(c) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def national_number(c) -> Column:
    """Digits without the +91 country prefix or leading zeros."""
    local = F.regexp_replace(F.trim(col(c)), r"^(\+91|0091)", "")
    return F.regexp_replace(digits(local), "^0+", "")


def json_strings(c) -> Column:
    """JSON list text to array<string>; NULL for anything that is not a JSON list."""
    return F.from_json(col(c), "array<string>")


def json_list(c) -> Column:
    """JSON list text to its distinct non-blank elements (elements themselves are not trimmed)."""
    return F.array_distinct(
        F.filter(json_strings(c), lambda x: x.isNotNull() & (F.trim(x) != "")))


def display_items(c) -> Column:
    """Items of a field that holds either plain text or a JSON list; NULL for plain text."""
    parsed = F.when(F.ltrim(col(c)).startswith("["), json_strings(c))
    return F.filter(F.transform(parsed, lambda x: F.coalesce(x, F.lit("null"))), lambda x: x != "")


def display_text(c) -> Column:
    """One display string for a field that holds either plain text or a JSON list."""
    items = display_items(c)
    return F.when(items.isNull(), F.when(col(c) != "", col(c))).otherwise(
        F.when(F.size(items) > 0, F.array_join(items, ", ")))


def matching_key(c) -> Column:
    """Case- and punctuation-free key for comparing names of people, places and addresses."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "))


def contains_pattern(term: str) -> str:
    return f"%{term.lower()}%"

