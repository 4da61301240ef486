"""Span algebra inside one row: find, resolve overlaps, cut and paste.

A span is a struct of start (from 0), length, tie rank, type, score, value.
Offsets count characters of the text the span was found in. The functions take
and give SQL text, to be used with ``expr``.
"""

from __future__ import annotations

from veilframe.functions.text import let, raw

SPAN = "struct<st:int,ln:int,pr:int,ty:string,score:double,v:string>"
SPANS = f"array<{SPAN}>"
MATCHES = "array<struct<st:int,ln:int,v:string>>"
NO_SPANS = f"cast(array() as {SPANS})"
NO_MATCHES = f"cast(array() as {MATCHES})"
# Stands in for text that a first pass has taken: no letter, digit or space.
BLANK = "￼"
# Two code points that are no characters.
MARK, STRAY = "\uffff", "\ufffe"
# Matches whose offsets are summed up together; pieces that are joined together.
BLOCK, PIECES = 256, 64
# Longer texts are searched part by part, cut before one of these characters.
PART = 8192
HARD_STOP = r"[!?;{}|=<>\[\]*&]"


def located(pieces: str) -> str:
    """Matches with offsets, from the ``pieces`` that pieces_of() gives.

    A match starts where the gaps and matches before it end. Lengths are summed
    up block by block, so that very many matches stay affordable; a single match
    needs no sum.
    """
    one = "array(named_struct('st', length(g[0]), 'ln', length(g[1]), 'v', g[1]))"
    pairs = "transform(sequence(1, size(g) - 2, 2), i -> named_struct('v', g[i], 'gap', g[i - 1]))"
    block = (
        f"aggregate(slice(ps, i * {BLOCK} + 1, {BLOCK}), "
        f"named_struct('pos', 0, 'out', {NO_MATCHES}), (acc, p) -> named_struct("
        "'pos', acc.pos + length(p.gap) + length(p.v), 'out', concat(acc.out, array("
        "named_struct('st', acc.pos + length(p.gap), 'ln', length(p.v), 'v', p.v)))))"
    )
    blocks = f"transform(sequence(0, cast((size(ps) - 1) div {BLOCK} as int)), i -> {block})"
    starts = running("bs", "pos", "x.pos")
    shifted = (
        f"flatten(zip_with(bs, {starts}, (x, o) -> transform(x.out, m -> "
        "named_struct('st', m.st + o, 'ln', m.ln, 'v', m.v))))"
    )
    several = let(pairs, "ps", let(blocks, "bs", shifted))
    return let(pieces, "g", f"if(size(g) = 3, {one}, {several})")


def running(items: str, name: str, amount: str) -> str:
    """For each of a few items the sum of ``amount`` over the items before it."""
    return (
        f"aggregate({items}, named_struct('{name}', 0, 'out', cast(array() as array<int>)), "
        f"(acc, x) -> named_struct('{name}', acc.{name} + {amount}, "
        f"'out', concat(acc.out, array(acc.{name}))), acc -> acc.out)"
    )


def unmarked(text: str) -> str:
    """``text`` without the mark that pieces_of() sets; a stray one is renamed."""
    return f"if(contains({text}, '{MARK}'), translate({text}, '{MARK}', '{STRAY}'), {text})"


def pieces_of(text: str, pattern: str) -> str:
    """Gaps and matches in turn, beginning and ending with a gap; null if nothing matches.

    One pass over the text, which unmarked() gives, sets a mark on both sides of each match.
    """
    marked = f"regexp_replace({text}, {raw(pattern)}, '{MARK}$0{MARK}')"
    return let(marked, "x", f"if(contains(x, '{MARK}'), split(x, '{MARK}', -1), null)")


def with_strays(matches: str, text: str, fields: str) -> str:
    """``matches`` of unmarked(text), with values of ``text`` where it has marks of its own."""
    own = f"transform({matches}, m -> named_struct({fields}, 'v', substring({text}, m.st + 1, m.ln)))"
    return f"if(contains({text}, '{MARK}'), {own}, {matches})"


def find_all(text: str, pattern: str) -> str:
    """All matches of ``pattern``, which must not match the empty string."""
    cut = let(pieces_of(unmarked("t"), pattern), "g0", f"if(g0 is null, {NO_MATCHES}, {located('g0')})")
    own = with_strays("ms", "t", "'st', m.st, 'ln', m.ln")
    return let(text, "t", f"if(t rlike {raw(pattern)}, {let(cut, 'ms', own)}, {NO_MATCHES})")


def parts(text: str) -> str:
    """A long text in parts of some thousand characters: base, len, t.

    Cuts are made only before characters that occur in no identifier, so that no
    match is cut and none begins at a cut by mistake.
    """
    pattern = raw(rf"(?s).{{{PART},}}?(?={HARD_STOP})|.+")
    texts = f"if(length(t) <= {2 * PART}, array(t), regexp_extract_all(t, {pattern}, 0))"
    with_base = (
        f"zip_with(ts, {running('ts', 'pos', 'length(x)')}, "
        "(x, o) -> named_struct('base', o, 'len', length(x), 't', x))"
    )
    return let(text, "t", let(texts, "ts", with_base))


def rejoined(parts: str, spans: str) -> str:
    """``parts`` of a text, put together again where one of ``spans`` reaches over a cut.

    The spans have the offsets of the text; each lies inside one part afterwards.
    """
    over = f"exists({spans}, x -> x.st < cs[i].base and x.st + x.ln > cs[i].base)"
    begins = f"filter(sequence(0, size(cs) - 1), i -> i = 0 or not {over})"
    until = "if(j + 1 < size(bs), bs[j + 1], size(cs))"
    end = f"(cs[{until} - 1].base + cs[{until} - 1].len)"
    whole = (
        f"transform(bs, (i, j) -> named_struct('base', cs[i].base, 'len', {end} - cs[i].base, "
        f"'t', array_join(transform(slice(cs, i + 1, {until} - i), c -> c.t), '')))"
    )
    return let(parts, "cs", f"if(size(cs) < 2, cs, {let(begins, 'bs', f'if(size(bs) = size(cs), cs, {whole})')})")


def overlap(a: str, b: str) -> str:
    return f"greatest({a}.st, {b}.st) < least({a}.st + {a}.ln, {b}.st + {b}.ln)"


def _kept(items: str) -> str:
    """Longest spans first, each kept if it touches none kept before; by start."""
    longest_first = (
        f"sort_array(transform({items}, s -> "
        "named_struct('nl', -s.ln, 'st', s.st, 'pr', s.pr, 's', s)))"
    )
    kept = (
        f"aggregate({longest_first}, {NO_SPANS}, (acc, x) -> "
        f"if(exists(acc, k -> {overlap('k', 'x.s')}), acc, concat(acc, array(x.s))))"
    )
    return f"sort_array({kept})"


def resolve_overlaps(spans: str) -> str:
    """Longest spans first, each kept if it touches none kept before; by start.

    Spans of equal length are taken by start, then by the rank of their pattern. Many spans are
    cut where none reaches over, once in each block of them, and compared inside the stretches only.
    """
    apart = (
        "not exists(zip_with(slice(o, 1, size(o) - 1), slice(o, 2, size(o)), "
        "(x, y) -> x.st + x.ln > y.st), z -> z)"
    )
    blocks = f"transform(sequence(0, (size(o) - 1) div {PIECES}), i -> slice(o, cast(i as int) * {PIECES} + 1, {PIECES}))"
    ends = "transform(bs, b -> array_max(transform(b, s -> s.st + s.ln)))"
    reached = (
        "aggregate(es, named_struct('m', 0, 'out', cast(array() as array<int>)), (a, e) -> "
        "named_struct('m', greatest(a.m, e), 'out', concat(a.out, array(a.m))), a -> a.out)"
    )
    # The first span of a block that begins where all before it have ended.
    first = (
        "aggregate(b, named_struct('m', m, 'j', 0, 'at', cast(null as int)), (a, s) -> "
        "named_struct('m', greatest(a.m, s.st + s.ln), 'j', a.j + 1, "
        "'at', coalesce(a.at, if(s.st >= a.m, a.j, null))), a -> a.at)"
    )
    firsts = f"zip_with(bs, rs, (b, m) -> {first})"
    cuts = f"filter(transform(fs, (f, i) -> f + i * {PIECES}), c -> c is not null)"
    stretch = "slice(o, c + 1, if(k + 1 < size(cs), cs[k + 1], size(o)) - c)"
    each = f"flatten(transform(cs, (c, k) -> {let(stretch, 'w', _kept('w'))}))"
    many = let(blocks, "bs", let(let(ends, "es", reached), "rs", let(let(firsts, "fs", cuts), "cs", each)))
    by_start = let(
        "sort_array(items)", "o",
        f"if(size(o) < 2 or {apart}, o, if(size(o) <= {PIECES}, {_kept('items')}, {many}))",
    )
    return let(spans, "items", f"if(size(items) < 1, items, {by_start})")


def splice(text: str, pieces: str) -> str:
    """Replace spans of ``text``; ``pieces`` has st, ln, rep and is sorted by st.

    Pieces are taken some at a time, and very many in stretches of such, so that a long text is
    not walked through from its beginning for each of them.
    """

    def stretch(s: str, size: int) -> str:
        # The stretch of text that ends with the last piece of the block.
        begin = f"if(i = 0, {s}.base, {s}.p[i - 1].st + {s}.p[i - 1].ln)"
        last = f"{s}.p[least(i + {size}, size({s}.p)) - 1]"
        return (
            f"named_struct('base', {begin}, 'p', slice({s}.p, i + 1, {size}), 't', "
            f"substring({s}.t, {begin} - {s}.base + 1, {last}.st + {last}.ln - {begin}))"
        )

    def in_blocks(s: str, size: int, name: str, body: str) -> str:
        done = let(stretch(s, size), name, body)
        return f"array_join(transform(sequence(0, size({s}.p) - 1, {size}), i -> {done}), '')"

    before = "if(j = 0, 0, b.p[j - 1].st + b.p[j - 1].ln - b.base)"
    filled = (
        "array_join(transform(b.p, (x, j) -> concat("
        f"substring(b.t, {before} + 1, x.st - b.base - {before}), x.rep)), '')"
    )
    few, many = in_blocks("s", PIECES, "b", filled), in_blocks("s", PIECES**2, "w", in_blocks("w", PIECES, "b", filled))
    end = "s.p[size(s.p) - 1].st + s.p[size(s.p) - 1].ln"
    return let(
        f"named_struct('base', 0, 't', {text}, 'p', {pieces})",
        "s",
        "if(coalesce(size(s.p), 0) < 1, s.t, "
        f"concat(if(size(s.p) <= {PIECES**2}, {few}, {many}), substring(s.t, {end} + 1)))",
    )


def blank_out(text: str, spans: str) -> str:
    """``text`` with each span overwritten, so all offsets stay as they are."""
    blanks = (
        f"transform({spans}, s -> named_struct("
        f"'st', s.st, 'ln', s.ln, 'rep', repeat('{BLANK}', s.ln)))"
    )
    return splice(text, blanks)
