"""Markup as text parts and tags, so that only the text is masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "<[^>]*>"


def text_parts(html: Column) -> Column:
    """The text before, between and after the tags; one more than there are tags."""
    return F.split(html, TAG, -1)


def tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TAG), F.lit(0))


def reassemble(parts: Column, tag_list: Column) -> Column:
    """Text parts and tags in turn."""
    return F.array_join(
        F.zip_with(
            parts, tag_list, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))
        ),
        "",
    )


# A token as it is and as markup; a text that has the latter itself is told apart by a
# number for the sign, with one more zero in front each time it is hidden.
_NAME = "([A-Z][A-Z_]*_[0-9]+)"
_LESS = f"&#(0*)60;(?={_NAME}&gt;)"


def hidden(part: Column) -> Column:
    """A masked text part as markup: its tokens would be read as tags otherwise."""
    own = F.regexp_replace(F.regexp_replace(part, _LESS, "&#0$160;"), f"&lt;(?={_NAME}&gt;)", "&#60;")
    return F.regexp_replace(own, f"<{_NAME}>", "&lt;$1&gt;")


def shown(part: Column) -> Column:
    """The masked text part that hidden() wrote."""
    tokens = F.regexp_replace(part, f"&lt;{_NAME}&gt;", "<$1>")
    return F.regexp_replace(F.regexp_replace(tokens, f"&#60;(?={_NAME}&gt;)", "&lt;"), f"&#0(0*)60;(?={_NAME}&gt;)", "&#$160;")


def _put_in(strings: Column, changes: Column) -> Column:
    return F.transform(strings, lambda p: F.coalesce(F.element_at(changes, p), p))


def html_changed(html: Column, changes: Column, put_in=_put_in) -> Column:
    """Markup with changed text parts, and tokens in them as markup."""
    return reassemble(F.transform(put_in(text_parts(html), changes), hidden), tags(html))


def html_restored(html: Column, changes: Column, put_in=_put_in) -> Column:
    """Masked markup with changed text parts, as they are in the original."""
    return reassemble(put_in(F.transform(text_parts(html), shown), changes), tags(html))
