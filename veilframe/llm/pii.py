"""Personal data in texts: patterns propose, checksums confirm, context adjusts the score.

Everything is an expression over one row: no shuffle, no Python. A pattern is
tried only where a cheaper test lets it. Matches come from one search and the text
between them from one split by the same pattern; offsets are running sums of both
lengths, taken in blocks, so very many matches in one text stay affordable.

Patterns are possessive and start only where a longer match could not have begun
earlier. That changes no match, but keeps the search linear on very long runs.

Where an account number ends is not a matter of form: groups of digits or capitals
may follow it. So every place that looks like the start of one is tried, with each
end at a sign boundary that leaves 15 to 34 signs. Of the ends that the checksum
confirms the one of the country's length counts, or else the last. Numbers found
from two starts may overlap.

Edge cases: a null text is empty and has no spans; a null doc_id stays null;
repeated rows give repeated result rows; other input columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
# Context is looked for in so many characters before a match.
REACH = 48
CONTEXT_BONUS = 0.3
# Kinds that a pattern alone does not prove need at least this score.
ENOUGH = 0.6

MATCH = "struct<st:int,en:int,v:string,w:string,near:string>"


@dataclass(frozen=True)
class Kind:
    name: str
    gate: str  # cheap pattern that every text with a match meets
    pattern: str
    valid: str  # SQL condition on v, the matched text
    prior: float
    context: str  # words that raise the score, as a pattern
    base: bool = True
    # SQL: how many characters of w, what the pattern's group saw after v, belong to the match; null if it is none.
    more: str = ""


DIGITS = "regexp_replace(v, '[^0-9]', '')"
PLAIN_PART = "trim(leading '0' from p)"
# Remainder by 97 of an account number: first four signs moved to the end, letters as 10 to 35.
MOD_97 = """aggregate(split(concat(substring(replace(v, ' ', ''), 5), substring(replace(v, ' ', ''), 1, 4)), ''),
  0, (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + ascii(c) - 48) % 97
  else (a * 100 + ascii(c) - 55) % 97 end)"""
# Signs of an account number by country.
LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
    "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
SIGNS = "length(replace(concat(v, substring(w, 1, n)), ' ', ''))"
# v: country and check digits, w: at most 30 more signs.
ACCOUNT_END = f"""array_max(transform(
  filter(sequence(11, length(w)), n -> substring(w, n, 1) != ' ' and substring(w, n + 1, 1) in ('', ' ')
    and {SIGNS} between 15 and 34 and exists(array(concat(v, substring(w, 1, n))), v -> {MOD_97} = 1)),
  n -> named_struct('known', contains('{LENGTHS}', concat(substring(v, 1, 2), {SIGNS})), 'n', n))).n"""

KINDS = (
    Kind(
        "email",
        "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        0.9,
        r"(?i)mail|contact|write|kontakt|correo|courriel",
    ),
    Kind(
        "ip",
        r"[0-9]\.[0-9]++\.[0-9]",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        f"forall(split(v, '[.]'), p -> if({PLAIN_PART} = '', 0, coalesce(try_cast({PLAIN_PART} as int), 256)) <= 255)",
        0.6,
        r"(?i)\bip\b|address|host|server|adresse",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9]){12}",
        r"[0-9](?:[\x20-]?[0-9])++",
        f"length({DIGITS}) between 13 and 19 and luhn_check({DIGITS})",
        0.7,
        r"(?i)card|credit|visa|master|karte|carte|tarjeta",
    ),
    Kind(
        "phone",
        r"\+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        f"length({DIGITS}) between 9 and 15",
        0.7,
        r"(?i)phone|call|mobile|fax|\btel|telefon|téléphone|teléfono",
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))",
        "true",
        0.9,
        r"(?i)iban|account|bank|konto|compte|cuenta",
        base=False,
        more=ACCOUNT_END,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "substring(v, 1, 3) not in ('000', '666') and v not like '9%' and v not like '%-00-%' and v not like '%-0000'",
        0.4,
        r"(?i)\bssn\b|social security",
        base=False,
    ),
)


def _running(items: str, amount: str, out: str, item: str) -> str:
    """Start of each item, as the sum of the amounts before it; ``item`` builds the result."""
    return (
        f"aggregate({items}, named_struct('p', 0, 'o', cast(array() as array<{out}>)), (acc, x) -> named_struct("
        f"'p', acc.p + {amount}, 'o', array_append(acc.o, {item})))"
    )


def _located(pairs: str) -> str:
    """SQL: matches with offsets from ``pairs`` of match v, gap g before it and text w seen after it."""
    match = (
        "named_struct('st', acc.p + length(x.g), 'en', acc.p + length(x.g) + length(x.v), "
        f"'v', x.v, 'w', x.w, 'near', right(x.g, {REACH}))"
    )
    block = _running(
        f"slice({pairs}, i * {BLOCK} + 1, {BLOCK})", "length(x.g) + length(x.v)", MATCH, match
    )
    return f"transform(sequence(0, cast((size({pairs}) - 1) div {BLOCK} as int)), i -> {block})"


def matches(docs: DataFrame, kind: Kind, text: str, to: str) -> DataFrame:
    """Adds ``to``: confirmed matches of one kind, by start, with their score."""
    t, p = F.col(text), F.lit(kind.pattern)
    tried = F.when(t.rlike(kind.gate), F.regexp_extract_all(t, p, F.lit(0)))
    df = docs.withColumn("_ms", tried)
    gaps = F.slice(F.split(t, kind.pattern, -1), F.lit(1), F.size("_ms"))
    after = F.regexp_extract_all(t, p, F.lit(1)) if kind.more else F.array_repeat(F.lit(""), F.size("_ms"))
    pairs = F.expr("transform(_zs, x -> named_struct('v', x._ms, 'g', x._gs, 'w', x._ws))")
    df = df.withColumn(
        "_zs", F.when(F.size("_ms") > 0, F.arrays_zip("_ms", gaps.alias("_gs"), after.alias("_ws")))
    )
    df = df.withColumn("_ps", F.when(F.size("_ms") > 0, pairs)).withColumn(
        "_bs", F.expr(f"if(_ps is null, null, {_located('_ps')})")
    )
    bases = _running("_bs", "x.p", "int", "acc.p")
    spans = (
        f"flatten(zip_with(_bs, ({bases}).o, (b, o) -> transform(b.o, m -> named_struct("
        "'st', m.st + o, 'en', m.en + o, 'v', m.v, 'w', m.w, 'near', m.near))))"
    )
    df = df.withColumn("_fs", F.expr(f"if(_bs is null, cast(array() as array<{MATCH}>), {spans})"))
    if kind.more:
        whole = (
            "named_struct('st', m.st, 'en', m.en + n, 'v', concat(m.v, substring(m.w, 1, n)), 'w', '', 'near', m.near)"
        )
        ends = f"flatten(transform(array(m.v), v -> transform(array(m.w), w -> {kind.more})))"
        ended = f"transform(filter({ends}, n -> n is not null), n -> {whole})"
        df = df.withColumn("_fs", F.expr(f"flatten(transform(_fs, m -> {ended}))"))
    score = f"{kind.prior}D + if(m.near rlike r'{kind.context}', {CONTEXT_BONUS}D, 0D)"
    keep = "" if kind.base else f" and {score} >= {ENOUGH}D"
    checked = (
        f"transform(filter(_fs, m -> exists(array(m.v), v -> {kind.valid}){keep}), m -> "
        f"named_struct('kind', '{kind.name}', 'start', m.st, 'end', m.en, 'value', m.v, "
        f"'score', least({score}, 1D)))"
    )
    return df.withColumn(to, F.expr(checked)).drop("_ms", "_zs", "_ps", "_bs", "_fs")


def find_pii(docs: DataFrame, text: str = "text", to: str = "pii", kinds=KINDS) -> DataFrame:
    """The input columns and ``to``: array of (kind, start, end, value, score), by kind, then start.

    Offsets count characters, the end is exclusive. A column named ``to`` is replaced.
    """
    source = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != to]).alias("_row")
    df = docs.select(source, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = []
    for kind in kinds:
        names.append(f"_found_{kind.name}")
        df = matches(df, kind, "_text", names[-1])
    return df.select("_row.*", F.concat(*names).alias(to))


def redacted(docs: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """``text`` with every span replaced by its kind in angle brackets.

    Spans that overlap are taken as one, named by the one that starts first.
    """
    ordered = f"array_sort(transform(`{pii}`, x -> named_struct('s', x.start, 'e', x.end, 'k', x.kind)))"
    merged = (
        f"aggregate({ordered}, cast(array() as array<struct<s:int,e:int,k:string>>), (acc, x) -> "
        "if(size(acc) > 0 and x.s < element_at(acc, -1).e, "
        "array_append(slice(acc, 1, size(acc) - 1), named_struct('s', element_at(acc, -1).s, "
        "'e', greatest(element_at(acc, -1).e, x.e), 'k', element_at(acc, -1).k)), array_append(acc, x)))"
    )
    pieces = (
        "concat(transform(_spans, (x, i) -> concat(substring(_t, if(i = 0, 1, _spans[i - 1].e + 1), "
        "x.s - if(i = 0, 0, _spans[i - 1].e)), '<', upper(x.k), '>')), "
        "array(substring(_t, element_at(_spans, -1).e + 1)))"
    )
    others = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select(*others, F.col(text).alias("_t"), F.expr(merged).alias("_spans"))
    new = F.when(F.size("_spans") > 0, F.expr(f"array_join({pieces}, '')")).otherwise(F.col("_t"))
    return df.withColumn(text, new).drop("_t", "_spans")


def _joined(spans: Column) -> Column:
    text = F.transform(
        spans,
        lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
    )
    return F.array_join(text, ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, best_score."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = find_pii(source, "text", "pii")
    base_names = [k.name for k in KINDS if k.base]
    counts = [F.expr(f"size(filter(pii, x -> x.kind = '{n}'))").cast("long").alias(f"n_{n}") for n in base_names]
    base = F.filter("pii", lambda x: x["kind"].isin(base_names))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max("pii.score"), F.lit(0.0)).alias("best_score"),
    )
