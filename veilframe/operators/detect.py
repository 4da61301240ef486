"""Detection: text in, spans out, all inside the row and without a shuffle.

Functions of patterns take and give SQL text, to be used with ``expr``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions import text as T
from veilframe.functions.text import let, raw
from veilframe.operators.patterns import (
    FIRST_PASS,
    FIRST_THRESHOLD,
    SECOND_PASS,
    SECOND_THRESHOLD,
    Pattern,
)
from veilframe.shared import spread


# The cheap tests a pattern may name in ``needs``; each runs once per text.
_GATES = {
    "digit": r"{t} rlike r'(?U)\d'",
    "3 digits": r"{t} rlike r'(?U)\d{{3}}'",
    # Kelvin sign and long s are letters k and s to a pattern that ignores case.
    "long word": (
        r"({t} rlike r'\b[0-9A-Za-z]{{17}}' or "
        "contains({t}, '\u017f') or contains({t}, '\u212a'))"
    ),
    "address": "contains({t}, ',') and {t} rlike '" + T.CYRILLIC + "'",
    "at": "contains({t}, '@')",
}


def _shape(upper: str) -> str:
    """``upper``, a text in upper case, with 0 for every digit and A for every letter of a plate, no spaces, hyphens, dots or brackets.

    What a pattern matches has one of the pattern's shapes in it, so a search for those plain strings
    spares most patterns. The shape may have one more often than the text; the pattern decides.
    """
    known = f"{T.DIGITS}{T.PLATE_LETTERS}{T.SPACES}-.()"
    return f"translate({upper}, '{known}', '{'0' * len(T.DIGITS)}{'A' * len(T.PLATE_LETTERS)}')"


def _matches(text: str, p: Pattern) -> str:
    """Matches of one pattern and the gaps between them; null if there is none.

    The text in upper case is bound to ``u``, its shape to ``f``.
    """
    tests = []
    if p.words:
        tests.append("(" + " or ".join(f"contains(u, '{w}')" for w in p.words) + ")")
    if p.shape:
        tests.append(f"contains(f, '{p.shape}')")
    pieces = S.pieces_of(text, p.compiled)
    if not p.shape:
        tests.append(f"{text} rlike {raw(p.compiled)}")
    found = f"if({' and '.join(tests)}, {pieces}, null)"
    return (
        f"named_struct('ty', '{p.ty}', 'pr', {p.rank}, 'score', double('{p.score}'), "
        f"'luhn', {str(p.luhn).lower()}, 'pieces', {found})"
    )


def _labelled(per_pattern: str) -> str:
    """One array of spans out of the matches of several patterns."""
    spans = (
        f"transform({S.located('q.pieces')}, m -> named_struct('st', m.st, 'ln', m.ln, "
        "'pr', q.pr, 'ty', q.ty, 'score', q.score, 'v', m.v))"
    )
    checked = let(spans, "ss", f"if(q.luhn, filter(ss, s -> {T.luhn_valid('s.v')}), ss)")
    return f"flatten(transform(filter({per_pattern}, q -> q.pieces is not null), q -> {checked}))"


def raw_spans(text: str, patterns: Sequence[Pattern]) -> str:
    """Spans of all patterns, overlaps included."""
    groups = []
    for gate in dict.fromkeys(p.needs for p in patterns):
        tried = f"array({', '.join(_matches('p', p) for p in patterns if p.needs == gate)})"
        if any(p.shape for p in patterns if p.needs == gate):
            tried = let(_shape("u"), "f", tried)
        if any(p.shape or p.words for p in patterns if p.needs == gate):
            tried = let(T.in_capitals("p"), "u", tried)
        test = _GATES.get(gate)
        groups.append(f"if({test.format(t='p')}, {tried}, null)" if test else tried)
    found = f"flatten(filter(array({', '.join(groups)}), g -> g is not null))"
    fields = "'st', m.st, 'ln', m.ln, 'pr', m.pr, 'ty', m.ty, 'score', m.score"
    own = let(let(S.unmarked("t"), "p", _labelled(found)), "ms", S.with_strays("ms", "t", fields))
    return f"coalesce({let(text, 't', own)}, {S.NO_SPANS})"


def pattern_spans(text: str, pattern: Pattern) -> str:
    return raw_spans(text, [pattern])


def above(spans: str, threshold: float) -> str:
    return f"filter({spans}, s -> s.score >= {threshold})"


def _first_pass(text: str, lang: str, families: dict[str, Sequence[Pattern]]) -> str:
    spans = S.NO_SPANS
    for family, patterns in families.items():
        spans = f"if({lang} = '{family}', {raw_spans(text, patterns)}, {spans})"
    return above(spans, FIRST_THRESHOLD)


def detect(text: str, lang: str) -> str:
    """First pass: the patterns of the text's language, without overlaps."""
    return S.resolve_overlaps(_first_pass(text, lang, FIRST_PASS))


def detect_second(
    text: str,
    taken: str,
    extra: str | None = None,
    patterns: Sequence[Pattern] = tuple(SECOND_PASS),
    threshold: float = SECOND_THRESHOLD,
) -> str:
    """Second pass, on the text with the first pass's spans blanked out.

    ``extra`` adds spans found elsewhere, such as names from a gazetteer.
    """
    found = raw_spans("r", patterns)
    if extra is not None:
        free = f"filter({extra}, x -> not exists({taken}, k -> {S.overlap('k', 'x')}))"
        found = (
            f"concat({found}, transform({free}, x -> named_struct('st', x.st, 'ln', x.ln, "
            "'pr', x.pr, 'ty', x.ty, 'score', x.score, 'v', substring(r, x.st + 1, x.ln))))"
        )
    return let(S.blank_out(text, taken), "r", above(found, threshold))


def with_parts(
    df: DataFrame,
    text: str = "text",
    lang: str = "auto",
    extra: str | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    """Add ``parts``: the spans of both passes, an array of base, len, spans.

    Spans have st, ln, pass, ty, v, norm; their offsets count from the part's
    base. ``extra`` names a column of spans for the second pass; a long text is not
    cut where one of them stands. The second pass runs where the text has letters or
    the first one has put a token. Each step is a column of its own, and none leaves
    the row.
    """
    key = T.strip if case_sensitive else T.norm
    # A language known beforehand leaves out the patterns of all others.
    families = {lang: FIRST_PASS[lang]} if lang in FIRST_PASS else FIRST_PASS

    def label(number: int) -> str:
        return (
            f"s -> named_struct('st', s.st, 'ln', s.ln, 'pass', {number}, "
            f"'ty', s.ty, 'v', s.v, 'norm', {key('s.v')})"
        )

    names = None
    if extra is not None:
        inside = "x.st >= c.base and x.st + x.ln <= c.base + c.len"
        names = (
            f"transform(filter(coalesce({extra}, {S.NO_SPANS}), x -> {inside}), "
            "x -> named_struct('st', x.st - c.base, 'ln', x.ln, 'pr', x.pr, 'ty', x.ty, "
            "'score', x.score, 'v', x.v))"
        )
    column = f"`{text}`"
    cut = f"if({column} is null or {T.is_blank(column)}, array(), {S.parts(column)})"
    if extra is not None:
        cut = S.rejoined(cut, f"coalesce({extra}, {S.NO_SPANS})")
    none = f"array_repeat({S.NO_SPANS}, size(_cut))"
    first = f"transform(_cut, c -> {_first_pass('c.t', '_lang', families)})"
    second = f"zip_with(_cut, _first, (c, f) -> {detect_second('c.t', 'f', names)})"
    joined = (
        "zip_with(_cut, zip_with(_first, _second, (f, g) -> sort_array(concat("
        f"transform(f, {label(1)}), transform(g, {label(2)})))), "
        "(c, x) -> named_struct('base', c.base, 'len', c.len, 'spans', x))"
    )
    steps = [
        ("_lang", effective_lang(column, lang)),
        ("_cut", cut),
        ("_first", first),
        ("_first", f"transform(_first, f -> {S.resolve_overlaps('f')})"),
        ("_open", f"{T.has_letters(column)} or exists(_first, f -> size(f) > 0)"),
        ("_second", f"if(_open, {second}, {none})"),
        ("_second", f"transform(_second, f -> {S.resolve_overlaps('f')})"),
        ("parts", joined),
    ]
    df = spread(df)
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df.drop("_lang", "_cut", "_first", "_open", "_second")


def spans_of(parts: str) -> str:
    """All spans of a text that was searched part by part, in the text's offsets."""
    return (
        f"flatten(transform({parts}, c -> transform(c.spans, s -> named_struct("
        "'st', s.st + c.base, 'ln', s.ln, 'pass', s.pass, 'ty', s.ty, 'v', s.v, 'norm', s.norm))))"
    )


def found_in(
    df: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "auto"
) -> DataFrame:
    """One row per span of both passes: the columns to keep, and the span's.

    The spans are exploded as an expression: over a column, a filter on its size
    would be put below, and the texts would be searched once more.
    """
    rows = with_parts(df, text, lang)
    return rows.select(*keep, F.explode(F.expr(spans_of("parts"))).alias("s")).select(*keep, "s.*")


def effective_lang(text: str, lang: str = "auto") -> str:
    """``auto`` asks the text; any other value wins.

    ``lang`` is a language, or the name of a column that holds one per text.
    """
    if lang == "auto":
        return T.language(text)
    if lang in FIRST_PASS:
        return f"'{lang}'"
    return f"if({lang} = 'auto', {T.language(text)}, {lang})"
