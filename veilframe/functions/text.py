"""Scalar text helpers, all built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
SENSITIVE_STEMS = [
    "зарплата", "оклад", "премия", "доход", "бонус", "выплата",
    "сумма", "стоимость", "бюджет", "salary", "bonus", "amount",
]
CYRILLIC = "[А-яЁё]"
NOT_SPACE = r"(?U)\S"
LETTERS = "[a-zA-ZА-яЁё]"
# ----------------------------------------------------------------------------

# First code point of decimal digit blocks besides ASCII that \d also matches.
_DIGIT_BLOCKS = (0x0660, 0x06F0, 0x0966, 0xFF10)
# What counts as whitespace, written as SQL escapes.
_SPACES = "".join(
    f"\\u{c:04x}"
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
# The same as characters, every decimal digit, the letters of plates and documents, and Russian letters.
SPACES = "".join(chr(int(c, 16)) for c in _SPACES.split("\\u")[1:])
DIGITS = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd")
PLATE_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZАВЕКМНОРСТУХ"
_CAPITALS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0x410, 0x430))) + "Ё")


def _folded() -> dict[str, str]:
    """Every character that a pattern takes for one of _CAPITALS when it ignores case."""
    found = {}
    for c in map(chr, range(0x110000)):
        for same in (c.upper(), c.upper().lower().upper(), c.lower().upper()):
            if same in _CAPITALS and c not in _CAPITALS:
                found[c] = same
    return found


FOLDED = _folded()
_OTHER_DIGITS = "".join(chr(base + i) for base in _DIGIT_BLOCKS for i in range(10))


# The next functions take and give SQL text, so that detection can be put together
# as one expression.


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` bound to ``name``, evaluated once.

    Each binding is one more level for the analyser to resolve, so long chains
    are better laid out as columns. A fold over nothing hands the value on as it is, where
    an element of a transformed array would be copied and its type worked out for every row.
    """
    return f"aggregate(cast(array() as array<int>), {value}, (_a, _x) -> _a, {name} -> {body})"


def raw(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return f'r"{pattern}"'


def strip(text: str) -> str:
    """Whitespace of any script removed from both ends."""
    return f"trim(BOTH '{_SPACES}' FROM {text})"


def norm(text: str) -> str:
    """The key under which two spellings count as one value."""
    return f"lower({strip(text)})"


def is_blank(text: str) -> str:
    return f"not ({text} rlike {raw(NOT_SPACE)})"


def in_capitals(text: str) -> str:
    """Latin and Russian letters in upper case, far cheaper than upper(); others stay."""
    return f"translate({text}, '{''.join(FOLDED)}', '{''.join(FOLDED.values())}')"


def language(text: str) -> str:
    """``ru`` as soon as one Cyrillic letter occurs, else ``en``."""
    return f"if({text} rlike '{CYRILLIC}', 'ru', 'en')"


def has_letters(text: str) -> str:
    return f"{text} rlike '{LETTERS}'"


def luhn_valid(value: str) -> str:
    """Card checksum over 13 to 19 digits; anything that is no digit is ignored."""
    ascii_digits = f"translate({value}, '{_OTHER_DIGITS}', '{'0123456789' * len(_DIGIT_BLOCKS)}')"
    # split by '' ends in one empty string.
    digits = "filter(split(reverse(d), ''), c -> c <> '')"
    weighted = (
        f"transform({digits}, (c, i) -> case when i % 2 = 0 then int(c) "
        "when int(c) > 4 then int(c) * 2 - 9 else int(c) * 2 end)"
    )
    valid = f"length(d) between 13 and 19 and aggregate({weighted}, 0, (a, x) -> a + x) % 10 = 0"
    return let(f"regexp_replace({ascii_digits}, '[^0-9]', '')", "d", f"coalesce({valid}, false)")


def is_sensitive_header(header: str | None) -> bool:
    """Driver-side test of one column name."""
    lowered = (header or "").lower()
    return any(stem in lowered for stem in SENSITIVE_STEMS)


def sensitive_header(header: Column) -> Column:
    """The same test for header names that are themselves data."""
    lowered = F.lower(header)
    hit = F.lit(False)
    for stem in SENSITIVE_STEMS:
        hit = hit | F.contains(lowered, F.lit(stem))
    return F.coalesce(hit, F.lit(False))


def numeric_round_trip(masked: Column) -> Column:
    """A masked number written as a number again where it still is one.

    A number with more digits than a double holds stays as it is written.
    """
    number = masked.try_cast("double")
    exact = masked.try_cast("decimal(38,9)") == number.try_cast("decimal(38,9)")
    return F.when(exact, number.cast("string")).otherwise(masked)


def titlecase_like(source: Column, target: Column) -> Column:
    """``target`` with a leading capital when ``source`` has one."""
    return F.when(source == F.initcap(source), F.initcap(target)).otherwise(target)


def preview(text: Column, length: int = 150) -> Column:
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def shortened_token(token: Column) -> Column:
    """How an access token is written in the audit log."""
    return F.when(token.isNull() | (token == ""), "no_token").otherwise(
        F.concat(F.substring(token, 1, 10), F.lit("..."))
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def identifier_list(ids: Column) -> Column:
    """``'a, b\\nc'`` as ``['a', 'b', 'c']``: commas and newlines separate, blanks go."""
    parts = F.split(F.replace(ids, F.lit("\n"), F.lit(",")), ",")
    return F.filter(F.transform(parts, _strip), lambda x: x != "")


def masked_name(filename: Column) -> Column:
    return F.concat(F.lit("safe_"), filename)


def restored_name(filename: Column) -> Column:
    """``safe_x`` becomes ``x`` again; any other name is marked as restored."""
    return F.when(
        filename.startswith("safe_"), F.regexp_replace(filename, "^safe_", "")
    ).otherwise(F.concat(F.lit("restored_"), filename))
