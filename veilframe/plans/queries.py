"""Every operator as a query over the given tables, with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import crypto, html
from veilframe.functions import spans as S
from veilframe.functions import text as T
from veilframe.operators import boxes, contain, detect, entities, gazetteer, names, quota, restoring, retrieval
from veilframe.operators import patterns as P
from veilframe.operators.fake_tokens import faked
from veilframe.operators.masking import KEY
from veilframe.plans import corpora as C
from veilframe.plans import files, jobs, oracle
from veilframe.shared import fresh_path, spread, staged
from veilframe.sources import delimited, leaves, readers, sessions, sinks
from veilframe.streaming import jobs as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SECRET = "a secret for the queries"
_TTL_NOW = "1998-06-01 12:00:00"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _expr(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


# --- Detectors -----------------------------------------------------------------


def _type_query(ty: str):
    texts = C.typed_texts(ty)

    @query(
        f"detect_{ty.lower()}",
        f"SELECT k, st, v FROM ({oracle.matches(texts, ty, 'k')})",
    )
    def run(spark, sf):
        found = detect.pattern_spans("text", P.BY_TYPE[ty])
        hits = C.corpus(spark, sf, texts).select("k", F.explode(F.expr(found)).alias("s"))
        return hits.select("k", "s.st", "s.v")


for _ty in C.TEMPLATES:
    _type_query(_ty)


@query(
    "detect_card_second_pass",
    "SELECT doc_id, st, v FROM ("
    + oracle.matches("SELECT doc_id, text FROM documents", "CREDIT_CARD", "doc_id")
    + ")",
)
def card_second_pass(spark, sf):
    """Cards in documents of any language, by the second pass alone."""
    second = [p for p in P.SECOND_PASS if p.luhn]
    found = S.resolve_overlaps(detect.raw_spans("text", second))
    docs = C.table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(F.expr(found)).alias("s")).select("doc_id", "s.st", "s.v")


@query(
    "cards_by_language",
    "SELECT lang, CAST(count(*) AS BIGINT) AS hits, "
    f"CAST(sum(CASE WHEN {oracle.luhn('v')} THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM ("
    "SELECT lang, unnest(regexp_extract_all(text, '\\b(?:\\d{4}[-\\s]?){3}\\d{4,7}\\b')) AS v "
    "FROM documents) GROUP BY lang",
)
def cards_by_language(spark, sf):
    """Card-shaped numbers per language, and how many pass the checksum."""
    shape = P.FLAGS + P.RU_FORMATS["CREDIT_CARD"]
    docs = C.table(spark, sf, "documents")
    hits = docs.select("lang", F.explode(F.expr(S.find_all("text", shape))).alias("m"))
    return hits.groupBy("lang").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(F.expr(T.luhn_valid("m.v")).cast("bigint")).alias("valid"),
    )


@query(
    "detect_names_by_gazetteer",
    f"WITH t AS ({C.NAMED_TEXTS}), g AS ({C.GAZETTEER}), w AS (SELECT k, text, unnest(range(1, 16)) AS i, "
    "regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}_#''’-]*') AS ws, "
    "string_split_regex(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}_#''’-]*') AS gs FROM t), "
    "n AS (SELECT k, text, i, j, array_to_string(ws[i:i+j-1], ' ') AS v, ws, gs, "
    "list_sum(list_transform(gs[1:i], lambda x: length(x))) "
    "+ coalesce(list_sum(list_transform(ws[1:i-1], lambda x: length(x))), 0) AS st "
    "FROM w, (SELECT unnest([1, 2, 3]) AS j) WHERE i + j - 1 <= len(ws)), "
    "h AS (SELECT k, CAST(st AS INT) AS st, CAST(length(v) AS INT) AS ln, g.ty, v FROM n JOIN g ON lower(v) = g.form) "
    "SELECT k, st, ty, v FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.k = a.k AND "
    "greatest(a.st, b.st) < least(a.st + a.ln, b.st + b.ln) AND b.ln > a.ln)",
)
def names_by_gazetteer(spark, sf):
    """Names from a list, the longest of overlapping ones."""
    texts = C.corpus(spark, sf, C.NAMED_TEXTS)
    listed = C.corpus(spark, sf, C.GAZETTEER)
    spans = gazetteer.gazetteer_spans(texts, listed, ["k"])
    joined = texts.join(spans, "k")
    second = detect.detect_second("text", S.NO_SPANS, "spans", patterns=[P.SECOND_PASS[0]])
    kept = F.expr(S.resolve_overlaps(second))
    return joined.select("k", F.explode(kept).alias("s")).select("k", "s.st", "s.ty", "s.v")


@query("detect_names_by_model")
def names_by_model(spark, sf):
    """A recogniser of the user's own, run over batches of texts."""
    texts = C.corpus(spark, sf, C.NAMED_TEXTS)
    spans = gazetteer.model_spans(texts, _capital_pairs, ["k"], "k bigint")
    return spans.select("k", F.explode("spans").alias("s")).select("k", "s.st", "s.ln", "s.ty")


def _capital_pairs(batches):
    import re

    import pandas as pd

    pair = re.compile(r"\bSupplier#\d+ from [A-Z_0-9]+")
    for batch in batches:
        rows = [
            (k, m.start(), len(m.group()), "PERSON", 0.95)
            for k, text in zip(batch["k"], batch["text"])
            for m in pair.finditer(text)
        ]
        yield pd.DataFrame(rows, columns=["k", "st", "ln", "ty", "score"])


# --- Predicates and scalar functions ---------------------------------------------

@query(
    "blank_guard",
    "SELECT doc_id, regexp_matches(t, '^\\s*$') AS blank FROM (SELECT doc_id, "
    "CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(10) || chr(9) WHEN doc_id % 3 = 1 THEN '' ELSE text END AS t "
    "FROM documents)",
)
def blank_guard(spark, sf):
    text = (
        "case when doc_id % 3 = 0 then concat(' ', chr(10), chr(9)) "
        "when doc_id % 3 = 1 then '' else text end"
    )
    docs = _expr(C.table(spark, sf, "documents"), doc_id="doc_id", t=text)
    return _expr(docs, doc_id="doc_id", blank=T.is_blank("t"))


_MIXED = (
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('Привет ', text) "
    "WHEN doc_id % 5 = 1 THEN '12345, 67' ELSE text END AS text FROM documents"
)


@query(
    "language_routing",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '[а-яА-ЯёЁ]') THEN 'ru' ELSE 'en' END AS detected, "
    "'ru' AS given FROM (" + _MIXED + ")",
)
def language_routing(spark, sf):
    texts = C.corpus(spark, sf, _MIXED)
    return _expr(
        texts,
        doc_id="doc_id",
        detected=detect.effective_lang("text", "auto"),
        given=detect.effective_lang("text", "ru"),
    )


_FAMILY = (
    f"SELECT group_id, doc_seq, unit_no, text FROM ({C.RU_CLIENTS}) UNION ALL "
    f"SELECT group_id, doc_seq + 1000000000, unit_no, text FROM ({C.EN_CLIENTS})"
)


@query(
    "pattern_family_by_language",
    f"SELECT doc_seq, st, ty, v FROM ({oracle.resolved(C.RU_CLIENTS, oracle.RU_TYPES)}) UNION ALL "
    f"SELECT doc_seq + 1000000000, st, ty, v FROM ({oracle.resolved(C.EN_CLIENTS, oracle.IN_TYPES)})",
)
def pattern_family(spark, sf):
    """Russian texts meet the Russian patterns, others the Indian ones."""
    found = F.expr(detect.detect("text", T.language("text")))
    texts = C.corpus(spark, sf, _FAMILY)
    return texts.select("doc_seq", F.explode(found).alias("s")).select("doc_seq", "s.st", "s.ty", "s.v")


@query(
    "letter_gate",
    "SELECT doc_id, regexp_matches(text, '[a-zA-Zа-яА-ЯёЁ]') AS letters FROM (" + _MIXED + ")",
)
def letter_gate(spark, sf):
    return _expr(C.corpus(spark, sf, _MIXED), doc_id="doc_id", letters=T.has_letters("text"))


_CARDS = f"SELECT c_custkey AS k, {C.filled('c_custkey', '{4} {4}-{4}{4}')} AS number FROM customer"


@query("luhn_check", f"SELECT k, {oracle.luhn('number')} AS valid FROM ({_CARDS})")
def luhn_check(spark, sf):
    return _expr(C.corpus(spark, sf, _CARDS), k="k", valid=T.luhn_valid("number"))


_HEADERS = (
    "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Зарплата сотрудника' WHEN 1 THEN 'Total AMOUNT' "
    "WHEN 2 THEN 'Имя' WHEN 3 THEN o_orderpriority ELSE 'Годовой бонус' END AS header FROM orders"
)


@query(
    "sensitive_header",
    "SELECT k, regexp_matches(lower(header), '"
    + "|".join(T.SENSITIVE_STEMS)
    + f"') AS sensitive FROM ({_HEADERS})",
)
def sensitive_header(spark, sf):
    heads = C.corpus(spark, sf, _HEADERS)
    return heads.select("k", T.sensitive_header(F.col("header")).alias("sensitive"))


@query(
    "score_thresholds",
    f"SELECT ty, CAST(count(*) AS BIGINT) AS kept FROM ({C.GAZETTEER}) WHERE score >= 0.92 GROUP BY ty",
)
def score_thresholds(spark, sf):
    """Spans below a pass's threshold are dropped."""
    listed = C.corpus(spark, sf, C.GAZETTEER)
    spans = listed.select(
        F.array(
            F.struct(
                F.lit(0).alias("st"), F.length("form").alias("ln"), F.lit(0).alias("pr"), "ty",
                F.col("score").cast("double").alias("score"), F.col("form").alias("v"),
            )
        ).alias("spans")
    )
    kept = spans.select(F.explode(F.expr(detect.above("spans", 0.92))).alias("s"))
    return kept.groupBy("s.ty").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "own_token_guard",
    "WITH v AS (SELECT DISTINCT c_nationkey AS group_id, CASE WHEN c_custkey % 2 = 0 THEN 'INN_RU' "
    "ELSE c_name END AS v FROM customer), t AS (SELECT DISTINCT c_nationkey AS group_id, "
    "'<INN_RU_' || c_custkey || '>' AS token FROM customer) "
    "SELECT group_id, v FROM v WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.group_id = v.group_id "
    "AND contains(t.token, v.v))",
)
def own_token_guard(spark, sf):
    people = C.table(spark, sf, "customer")
    values = people.selectExpr(
        "c_nationkey as group_id", "if(c_custkey % 2 = 0, 'INN_RU', c_name) as v"
    ).distinct()
    tokens = people.selectExpr(
        "c_nationkey as group_id", "concat('<INN_RU_', c_custkey, '>') as token"
    ).distinct()
    return entities.own_token_guard(values, tokens)


@query(
    "numeric_round_trip",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '<X_1>' "
    "WHEN o_orderkey % 3 = 0 THEN '17.5' ELSE '42.0' END AS cell FROM orders",
)
def numeric_round_trip(spark, sf):
    masked = "case when o_orderkey % 2 = 0 then '<X_1>' when o_orderkey % 3 = 0 then '17.50' else '42' end"
    cells = C.table(spark, sf, "orders").selectExpr("o_orderkey as k", f"{masked} as m")
    return cells.select("k", T.numeric_round_trip(F.col("m")).alias("cell"))


@query(
    "scalar_strings",
    "SELECT c_custkey AS k, trim(c_name) AS stripped, lower(trim(c_name)) AS norm, "
    "substr(c_name, 1, 8) AS head, length(c_name) AS len, replace(c_name, '#', '-') AS dashed, "
    "array_to_string(string_split(c_name, '#'), '/') AS joined, starts_with(c_name, 'Cust') AS starts, "
    "contains(c_mktsegment, 'BUILD') AS inside FROM customer",
)
def scalar_strings(spark, sf):
    return _expr(
        C.table(spark, sf, "customer"),
        k="c_custkey",
        stripped=T.strip("concat('  ', c_name, chr(9))"),
        norm=T.norm("concat(' ', c_name, ' ')"),
        head="substring(c_name, 1, 8)",
        len="cast(length(c_name) as bigint)",
        dashed="replace(c_name, '#', '-')",
        joined="array_join(split(c_name, '#'), '/')",
        starts="startswith(c_name, 'Cust')",
        inside="contains(c_mktsegment, 'BUILD')",
    )


@query(
    "titlecase_kept",
    "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) "
    "ELSE lower(p_brand) END AS word FROM part",
)
def titlecase_kept(spark, sf):
    source = F.expr("if(p_partkey % 2 = 0, 'Иванов', 'иванов')")
    return C.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), T.titlecase_like(source, F.lower("p_brand")).alias("word")
    )


@query("digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digest(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "text_preview",
    "SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview "
    "FROM documents",
)
def text_preview(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(
    "token_shortened",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'no_token' "
    "ELSE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 10) || '...' END AS token FROM orders",
)
def token_shortened(spark, sf):
    raw = F.expr(
        "case when o_orderkey % 8 = 0 then '' when o_orderkey % 4 = 0 then null "
        "else md5(cast(o_orderkey as string)) end"
    )
    return C.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), T.shortened_token(raw).alias("token")
    )


@query(
    "identifier_list",
    "SELECT req, CAST(i - 1 AS INT) AS \"at\", l[i] AS id FROM (SELECT req, l, unnest(range(1, len(l) + 1)) AS i FROM ("
    "SELECT req, list_filter(list_transform(string_split(replace(ids, chr(10), ','), ','), "
    f"lambda x: trim(x)), lambda x: x <> '') AS l FROM ({C.REQUESTS})))",
)
def identifier_list(spark, sf):
    wanted = C.corpus(spark, sf, C.REQUESTS)
    return wanted.select("req", F.posexplode(T.identifier_list(F.col("ids"))).alias("at", "id"))


@query(
    "file_names",
    "SELECT k, 'safe_' || f AS masked, CASE WHEN starts_with(f, 'safe_') THEN substr(f, 6) "
    "ELSE 'restored_' || f END AS restored FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 "
    "THEN 'safe_' || p_name || '.docx' ELSE p_name || '.txt' END AS f FROM part)",
)
def file_names(spark, sf):
    named = C.table(spark, sf, "part").selectExpr(
        "p_partkey as k",
        "if(p_partkey % 2 = 0, concat('safe_', p_name, '.docx'), concat(p_name, '.txt')) as f",
    )
    return named.select(
        "k", T.masked_name(F.col("f")).alias("masked"), T.restored_name(F.col("f")).alias("restored")
    )


@query("identity_and_time")
def identity_and_time(spark, sf):
    """Fresh identifiers and time arithmetic; only their shape can be checked."""
    return C.table(spark, sf, "orders").select(
        "o_orderkey",
        F.uuid().alias("id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("now"),
        (F.col("o_orderdate") - F.make_dt_interval(hours=F.lit(24))).alias("day_before"),
    )


# --- Span algebra ------------------------------------------------------------------

_DIGITS = r"\d{2,}"


@query(
    "find_all_with_offsets",
    "SELECT doc_seq, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) "
    "+ coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS st, m[i] AS v "
    f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_seq, regexp_extract_all(text, '{_DIGITS}') AS m, "
    f"string_split_regex(text, '{_DIGITS}') AS g FROM ({C.RU_ORDERS})))",
)
def find_all_with_offsets(spark, sf):
    texts = C.corpus(spark, sf, C.RU_ORDERS)
    found = F.expr(S.find_all("text", _DIGITS))
    return texts.select("doc_seq", F.explode(found).alias("m")).select("doc_seq", "m.st", "m.v")


@query(
    "overlaps_resolved",
    f"SELECT doc_seq, st, ln, ty, v FROM ({oracle.resolved(C.RU_CLIENTS, oracle.RU_TYPES)})",
)
def overlaps_resolved(spark, sf):
    kept = F.expr(S.resolve_overlaps(detect.raw_spans("text", P.RU)))
    texts = spread(C.corpus(spark, sf, C.RU_CLIENTS))
    return texts.select("doc_seq", F.explode(kept).alias("s")).select("doc_seq", "s.st", "s.ln", "s.ty", "s.v")


@query(
    "spans_spliced",
    f"SELECT doc_seq, regexp_replace(text, '{_DIGITS}', '<N>', 'g') AS spliced FROM ({C.RU_ORDERS})",
)
def spans_spliced(spark, sf):
    pieces = (
        f"transform({S.find_all('text', _DIGITS)}, m -> "
        "named_struct('st', m.st, 'ln', m.ln, 'rep', '<N>'))"
    )
    texts = C.corpus(spark, sf, C.RU_ORDERS)
    return _expr(texts, doc_seq="doc_seq", spliced=S.splice("text", pieces))


@query(
    "two_passes",
    f"SELECT doc_seq, pass, st, ty, v FROM ({oracle.found(C.RU_ORDERS, oracle.RU_TYPES)})",
)
def two_passes(spark, sf):
    texts = C.corpus(spark, sf, C.RU_ORDERS)
    found = detect.found_in(texts, ["doc_seq"], lang="ru")
    return found.select("doc_seq", "pass", "st", "ty", "v")


@query(
    "interval_overlap_join",
    f"WITH a AS ({oracle.resolved(C.RU_CLIENTS, oracle.RU_TYPES)}), "
    f"b AS ({oracle.matches(C.RU_CLIENTS, 'INTL_PASSPORT_RU', oracle.KEYS)}) "
    "SELECT b.doc_seq, b.st, b.v FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_seq = b.doc_seq "
    "AND a.ty <> 'INTL_PASSPORT_RU' AND a.st < b.st + b.ln AND b.st < a.st + a.ln)",
)
def interval_overlap_join(spark, sf):
    """Spans that touch no span of another pass: a range join inside each text."""
    texts = C.corpus(spark, sf, C.RU_CLIENTS)
    key = ["group_id", "doc_seq", "unit_no"]
    first = texts.select(*key, F.explode(F.expr(detect.detect("text", "'ru'"))).alias("s"))
    first = first.select(*key, "s.st", "s.ln", "s.ty").where("ty <> 'INTL_PASSPORT_RU'")
    passport = detect.pattern_spans("text", P.BY_TYPE["INTL_PASSPORT_RU"])
    second = texts.select(*key, F.explode(F.expr(passport)).alias("s")).select(*key, "s.st", "s.ln", "s.v")
    a, b = first.alias("a"), second.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    touch = (F.col("a.st") < F.col("b.st") + F.col("b.ln")) & (F.col("b.st") < F.col("a.st") + F.col("a.ln"))
    return b.join(a, [*same, touch], "left_anti").select("doc_seq", "st", "v")


# --- Entities and tokens -----------------------------------------------------------


def _ru_orders(spark, sf, **options) -> jobs.MaskResult:
    texts = C.corpus(spark, sf, C.RU_ORDERS)
    return jobs.mask(texts, group="group_id", unit="unit_no", lang="ru", **options)


_ENTITIES = oracle.entities(C.RU_ORDERS, oracle.RU_TYPES)


@query("canonical_entities", f"SELECT group_id, norm, ty, original FROM ({_ENTITIES})")
def canonical_entities(spark, sf):
    """One entry per value of a group, as first met."""
    texts = C.corpus(spark, sf, C.RU_ORDERS)
    found = detect.found_in(texts, KEY, lang="ru")
    first = entities.first_mentions(found)
    return first.select("group_id", "norm", "ty", "original")


@query("tag_numbering", f"SELECT group_id, norm, n, token FROM ({_ENTITIES})")
def tag_numbering(spark, sf):
    found = _ru_orders(spark, sf).entities
    return found.select("group_id", "norm", F.col("n").cast("bigint").alias("n"), "token")


@query(
    "ordinals_in_hot_group",
    "SELECT group_id, doc_seq, row_number() OVER (PARTITION BY group_id ORDER BY doc_seq) AS n "
    f"FROM ({C.SKEWED_ORDERS})",
)
def ordinals_in_hot_group(spark, sf):
    """Ordinals where one group holds a third of all rows."""
    texts = C.corpus(spark, sf, C.SKEWED_ORDERS).select("group_id", "doc_seq")
    return entities.with_ordinals(texts, ["group_id"], "doc_seq", [])


_EARLY = f"SELECT * FROM ({C.RU_ORDERS}) WHERE doc_seq % 2 = 0"


def _in_two_runs(texts: DataFrame, **options) -> tuple[jobs.MaskResult, jobs.MaskResult]:
    cols = dict(group="group_id", unit="unit_no", lang="ru", **options)
    one = jobs.mask(texts.where("doc_seq % 2 = 0"), **cols)
    return one, jobs.mask(texts.where("doc_seq % 2 <> 0"), existing=one.entities, **cols)


@query(
    "numbering_continued",
    f"WITH a AS ({oracle.entities(_EARLY, oracle.RU_TYPES)}), "
    f"b AS ({oracle.entities(f'SELECT * FROM ({C.RU_ORDERS}) WHERE doc_seq % 2 <> 0', oracle.RU_TYPES)}), "
    "fresh AS (SELECT b.group_id, b.norm, b.ty, b.o FROM b WHERE NOT EXISTS (SELECT 1 FROM a "
    "WHERE a.group_id = b.group_id AND a.norm = b.norm)), "
    "c AS (SELECT group_id, ty, count(*) AS c FROM a GROUP BY ALL) "
    "SELECT fresh.group_id, fresh.norm, '<' || fresh.ty || '_' || (coalesce(c.c, 0) + row_number() OVER "
    "(PARTITION BY fresh.group_id, fresh.ty ORDER BY fresh.o)) || '>' AS token "
    "FROM fresh LEFT JOIN c ON c.group_id = fresh.group_id AND c.ty = fresh.ty UNION ALL "
    "SELECT a.group_id, a.norm, a.token FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.group_id = b.group_id "
    "AND a.norm = b.norm)",
)
def numbering_continued(spark, sf):
    """A second run keeps known tokens and goes on counting."""
    _, two = _in_two_runs(C.corpus(spark, sf, C.RU_ORDERS))
    return two.entities.select("group_id", "norm", "token")


@query("fake_tokens")
def fake_tokens(spark, sf):
    """Stand-ins for every type, one row per distinct value."""
    found = [
        f"named_struct('unit_no', {i}, 'spans', transform({T.let(C.filled('c_custkey', template), 'text', detect.pattern_spans('text', P.BY_TYPE[ty]))}, "
        "s -> named_struct('st', s.st, 'ln', s.ln, 'pass', 1, 'ty', s.ty, "
        f"'v', s.v, 'norm', {T.norm('s.v')})))"
        for i, (ty, template) in enumerate(C.TEMPLATES.items())
    ]
    texts = spread(C.table(spark, sf, "customer")).select(
        F.expr("concat('g', cast(c_custkey % 7 as string))").alias("group_id"),
        F.col("c_custkey").alias("doc_seq"),
        F.explode(F.expr(f"array({', '.join(found)})")).alias("u"),
    )
    spans = texts.select("group_id", "doc_seq", "u.unit_no", "u.spans")
    # Written down, as numbering reads it twice and the texts should be searched once.
    first = staged(entities.first_mentions(entities.mentions(spans, "spans")), "first")
    numbered = staged(entities.number_entities(first), "numbered")
    return faked(numbered, SECRET).select("group_id", "norm", "ty", "original", "token")


def _stand_in_counts() -> str:
    """group_id, ty, n of the distinct values of fake_tokens()."""
    types = list(C.TEMPLATES)
    every = " UNION ALL ".join(
        f"SELECT 'g' || (k % 7) AS group_id, lower(trim(v)) AS norm, '{ty}' AS ty, k AS a, {i} AS b, -st AS c "
        f"FROM ({oracle.matches(C.typed_texts(ty), ty, 'k')})"
        for i, ty in enumerate(types)
    )
    return (
        "SELECT group_id, ty, count(*) AS n FROM (SELECT group_id, norm, arg_min(ty, {'a': a, 'b': b, 'c': c}) AS ty "
        f"FROM ({every}) GROUP BY group_id, norm) GROUP BY group_id, ty"
    )


@query(
    "stand_in_forms",
    f"SELECT group_id, ty, n AS entities, n AS tokens, n AS well_formed, 0::BIGINT AS originals FROM ({_stand_in_counts()})",
)
def stand_in_forms(spark, sf):
    """Per group and type: values, different stand-ins, those of the type's form, and those that are an original."""
    made = staged(fake_tokens(spark, sf), "fakes")
    originals = made.select("group_id", F.col("norm").alias("key")).withColumn("own", F.lit(1))
    met = made.withColumn("key", F.expr(T.norm("token"))).join(originals, ["group_id", "key"], "left")

    def shape(value: str):
        return F.regexp_replace(F.regexp_replace(value, "[0-9]", "#"), r"\p{L}", "@")

    formed = F.col("ty").startswith("VEHICLE_") & (shape("token") == shape("original"))
    for ty in C.TEMPLATES:
        # Any other stand-in is found by the pattern that finds the type.
        if not ty.startswith("VEHICLE_"):
            form = _KEYWORDED.get(ty) or rf"(?U){P.BY_TYPE[ty].compiled}"
            formed = formed | ((F.col("ty") == ty) & F.col("token").rlike(form))
    return met.groupBy("group_id", "ty").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_distinct("token").alias("tokens"),
        F.sum(formed.cast("bigint")).alias("well_formed"),
        F.count("own").alias("originals"),
    )


# Patterns that need a word before the number; and the plain form of an address.
_KEYWORDED = {
    "INN_RU": r"^(\d{10}|\d{12})$",
    "KPP_RU": r"^\d{9}$",
    "OMS_RU": r"^\d{16}$",
    "ADDRESS_RU": r"^г\. \S+, ул\. \S+, д\. \d+, кв\. \d+$",
}


@query("fake_collisions")
def fake_collisions(spark, sf):
    """Stand-ins that equal an original or each other within a group: none."""
    made = staged(fake_tokens(spark, sf), "fakes")
    originals = made.select("group_id", F.col("norm").alias("key"))
    as_original = made.withColumn("key", F.expr(T.norm("token"))).join(
        originals, ["group_id", "key"], "left_semi"
    )
    twice = made.groupBy("group_id", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return as_original.select(F.lit("original").alias("problem"), "group_id", "token").unionByName(
        twice.select(F.lit("twice").alias("problem"), "group_id", "token")
    )


ORACLE["fake_collisions"] = (
    "SELECT 'original' AS problem, '' AS group_id, '' AS token FROM customer WHERE c_custkey < 0"
)

# A surname per customer with its six cases; every third one has no case table.
_ENDINGS = dict(zip(names.CASES, names.SURNAME_ENDINGS))
_FORMS = " UNION ALL ".join(
    f"SELECT concat('клиентов', substr('абвгдежзиклмнопрстуфхцчшщэюя', cast(c_custkey % 28 as int) + 1, 1), cast(c_custkey as string), 'ин') AS lemma, "
    f"'{case}' AS case, concat('клиентов', substr('абвгдежзиклмнопрстуфхцчшщэюя', cast(c_custkey % 28 as int) + 1, 1), "
    f"cast(c_custkey as string), 'ин{ending}') AS form FROM customer WHERE c_custkey % 3 <> 0"
    for case, ending in _ENDINGS.items()
)
_PEOPLE = (
    "SELECT cast(c_nationkey as string) AS group_id, concat('клиентов', substr('абвгдежзиклмнопрстуфхцчшщэюя', cast(c_custkey % 28 as int) + 1, 1), "
    "cast(c_custkey as string), 'ину') AS norm, concat('Клиентов', substr('абвгдежзиклмнопрстуфхцчшщэюя', cast(c_custkey % 28 as int) + 1, 1), "
    "cast(c_custkey as string), 'ину') AS original, concat('Подменов', cast(c_custkey as string), 'ев') AS token "
    "FROM customer"
)
_FAKE_FORMS = " UNION ALL ".join(
    f"SELECT concat('подменов', cast(c_custkey as string), 'ев') AS lemma, '{case}' AS case, "
    f"concat('подменов', cast(c_custkey as string), 'ев{ending}') AS form FROM customer"
    for case, ending in _ENDINGS.items()
)
_CASES_SQL = (
    f"WITH f AS ({_FORMS} UNION ALL {_FAKE_FORMS}), p AS ({_PEOPLE}), "
    f"c AS (SELECT unnest({names.CASES!r}) AS case), "
    "l AS (SELECT form, min(lemma) AS lemma FROM f GROUP BY form), "
    "r AS (SELECT p.group_id, p.norm, c.case, "
    "coalesce((SELECT upper(substr(any_value(f.form), 1, 1)) || substr(any_value(f.form), 2) FROM f, l WHERE l.form = lower(p.token) AND f.lemma = l.lemma "
    "AND f.case = c.case), p.token) AS token, "
    "coalesce((SELECT upper(substr(any_value(f.form), 1, 1)) || substr(any_value(f.form), 2) FROM f, l WHERE l.form = lower(p.original) AND f.lemma = l.lemma "
    "AND f.case = c.case), p.original) AS original FROM p, c) "
    "SELECT group_id, norm, case, token, original, words FROM r, (SELECT unnest([true, false]) AS words)"
)


@query("person_case_forms", _CASES_SQL.replace(" case ", ' "case" ').replace("AS case", 'AS "case"').replace(".case", '."case"').replace(", case,", ', "case",'))
def person_case_forms(spark, sf):
    """Six forms per person, the stand-in's form mapped to the original's."""
    forms = C.corpus(spark, sf, _FORMS).unionByName(C.corpus(spark, sf, _FAKE_FORMS))
    people = C.corpus(spark, sf, _PEOPLE)
    return names.case_forms(people, forms).select("group_id", "norm", "case", "token", "original", "words")


@query(
    "word_level_map",
    "SELECT k, fw AS token, ow AS original FROM (SELECT k, unnest(string_split(f, ' ')) AS fw, "
    "unnest(string_split(o, ' ')) AS ow FROM (SELECT p_partkey AS k, p_name AS o, p_type || ' of ' || p_brand AS f "
    "FROM part) WHERE len(string_split(f, ' ')) = len(string_split(o, ' '))) WHERE length(fw) > 3",
)
def word_level_map(spark, sf):
    """Words of stand-ins mapped one by one where both sides have equally many."""
    pairs = C.table(spark, sf, "part").selectExpr(
        "p_partkey as k", "split(p_name, ' ') as o", "split(concat(p_type, ' of ', p_brand), ' ') as f"
    ).where("size(o) = size(f)")
    left = pairs.select("k", F.posexplode("f").alias("at", "token"))
    right = pairs.select("k", F.posexplode("o").alias("at", "original"))
    return left.join(right, ["k", "at"]).where(F.length("token") > names.LONG_WORD).select("k", "token", "original")


@query(
    "word_level_map_of_names",
    "SELECT k, fw AS token, ow AS original FROM (SELECT c_custkey AS k, unnest(['Ivan', 'Petrov' || c_custkey, 'Li']) AS fw, "
    "unnest(string_split(c_name, '#') || [c_mktsegment]) AS ow FROM customer WHERE c_custkey % 3 <> 0) WHERE length(fw) > 3",
)
def word_level_map_of_names(spark, sf):
    """Words of three-word stand-ins mapped to those of originals of three words; others have none."""
    pairs = C.table(spark, sf, "customer").selectExpr(
        "c_custkey as k",
        "split(concat('Ivan Petrov', c_custkey, ' Li'), ' ') as f",
        "split(concat(replace(c_name, '#', ' '), ' ', c_mktsegment, if(c_custkey % 3 = 0, ' more', '')), ' ') as o",
    ).where("size(o) = size(f)")
    left = pairs.select("k", F.posexplode("f").alias("at", "token"))
    right = pairs.select("k", F.posexplode("o").alias("at", "original"))
    return left.join(right, ["k", "at"]).where(F.length("token") > names.LONG_WORD).select("k", "token", "original")


@query(
    "map_merge_last_wins",
    f"WITH s AS ({C.SESSIONS}), t AS ({C.SESSION_TOKENS}) SELECT s.group_id, t.token, "
    "arg_max(t.original, {'a': s.created_at, 'b': s.session_id}) AS original FROM s JOIN t "
    "ON s.session_id = t.session_id WHERE s.group_id IS NOT NULL GROUP BY s.group_id, t.token",
)
def map_merge_last_wins(spark, sf):
    return sessions.group_map(_session_tokens(spark, sf)).select("group_id", "token", "original")


def _session_tokens(spark, sf) -> DataFrame:
    rows = C.corpus(spark, sf, C.SESSIONS).select("session_id", "group_id", "created_at")
    return rows.join(C.corpus(spark, sf, C.SESSION_TOKENS), "session_id")


_MASKED_ORDERS = oracle.masked(C.RU_ORDERS, oracle.RU_TYPES)
_REPEATED = (
    "SELECT cast(c_nationkey as string) AS group_id, o_orderkey AS doc_seq, 0 AS unit_no, "
    f"{C._CLIENT} AS text FROM orders JOIN customer ON o_custkey = c_custkey"
)


@query(
    "repeated_texts_masked_once",
    f"SELECT doc_seq, masked_text FROM ({oracle.masked(_REPEATED, oracle.RU_TYPES)})",
)
def repeated_texts(spark, sf):
    """Equal texts of a group are searched once and share the result."""
    texts = C.corpus(spark, sf, _REPEATED)
    done = jobs.mask(texts, group="group_id", unit="unit_no", lang="ru", reuse=True)
    return done.masked.select("doc_seq", "masked_text")


@query("counts_per_text", f"SELECT doc_seq, spans_found, map_size FROM ({_MASKED_ORDERS})")
def counts_per_text(spark, sf):
    return _ru_orders(spark, sf).masked.select("doc_seq", "spans_found", "map_size")


@query("mask_tags", f"SELECT group_id, doc_seq, masked_text FROM ({_MASKED_ORDERS})")
def mask_tags(spark, sf):
    return _ru_orders(spark, sf).masked.select("group_id", "doc_seq", "masked_text")


@query(
    "mask_tags_hot_group",
    f"SELECT group_id, doc_seq, masked_text FROM ({oracle.masked(C.SKEWED_ORDERS, oracle.RU_TYPES)})",
)
def mask_tags_hot_group(spark, sf):
    texts = C.corpus(spark, sf, C.SKEWED_ORDERS)
    return jobs.mask(texts, group="group_id", lang="ru").masked.select("group_id", "doc_seq", "masked_text")


@query(
    "mask_tags_english",
    f"SELECT group_id, doc_seq, masked_text FROM ({oracle.masked(C.EN_CLIENTS, oracle.IN_TYPES)})",
)
def mask_tags_english(spark, sf):
    texts = C.corpus(spark, sf, C.EN_CLIENTS)
    return jobs.mask(texts, group="group_id", lang="en").masked.select("group_id", "doc_seq", "masked_text")


@query("mask_documents")
def mask_documents(spark, sf):
    """Whole documents with stand-ins, a source being a group."""
    docs = C.table(spark, sf, "documents")
    done = jobs.mask(docs, seq="doc_id", group="source", mode="fake", secret=SECRET)
    return done.masked.select("doc_id", "masked_text", "spans_found")


# --- Restoring -----------------------------------------------------------------------


def _spelled_once(source: str) -> str:
    return f"SELECT group_id, doc_seq, text AS restored_text FROM ({source})"


@query("restore_tags", _spelled_once(C.RU_ORDERS))
def restore_tags(spark, sf):
    """Masking and restoring gives the texts back."""
    done = _ru_orders(spark, sf)
    back = jobs.restore_group(done.masked.drop("text"), "masked_text", done.token_map)
    return back.select("group_id", "doc_seq", "restored_text")


@query("restore_fakes", _spelled_once(C.RU_CLIENTS))
def restore_fakes(spark, sf):
    texts = C.corpus(spark, sf, C.RU_CLIENTS)
    done = jobs.mask(texts, group="group_id", lang="ru", mode="fake", secret=SECRET)
    back = jobs.restore_group(done.masked.drop("text"), "masked_text", done.token_map)
    return back.select("group_id", "doc_seq", "restored_text")


@query(
    "restore_by_fold",
    "SELECT o_orderkey AS k, 'see order ' || o_orderkey || ' and ' || o_orderpriority || '!' AS restored FROM orders",
)
def restore_by_fold(spark, sf):
    """Small maps: every token replaced in turn, longest first; large ones by a join."""
    tokens = C.corpus(spark, sf, C.SESSION_TOKENS)
    texts = C.table(spark, sf, "orders").selectExpr(
        "o_orderkey as k", "md5(cast(o_orderkey as string)) as session_id",
        "concat('see <ORDER_', o_orderkey, '> and <PRIORITY_1>!') as text",
    )
    return restoring.restore_folding(texts, "text", tokens, ["session_id"], ["k"], "restored").select("k", "restored")


@query(
    "restore_quoting_reply",
    f"SELECT group_id, doc_seq, 'Получено: ' || text || '. Готово.' AS restored_text FROM ({C.RU_ORDERS})",
)
def restore_quoting_reply(spark, sf):
    """Replies that quote masked text in new surroundings."""
    done = _ru_orders(spark, sf)
    replies = done.masked.select(
        *KEY, F.concat(F.lit("Получено: "), "masked_text", F.lit(". Готово.")).alias("reply")
    )
    back = jobs.restore_group(replies, "reply", done.token_map)
    return back.select("group_id", "doc_seq", "restored_text")


# --- Joins of texts, maps and sessions ---------------------------------------------------


@query(
    "text_with_group_map",
    f"WITH e AS ({_ENTITIES}) SELECT t.doc_seq, CAST(count(e.token) AS BIGINT) AS known FROM ({C.RU_CLIENTS}) t "
    "LEFT JOIN (SELECT group_id, count(*) AS token FROM e GROUP BY ALL) c ON c.group_id = t.group_id "
    "LEFT JOIN e ON e.group_id = t.group_id AND contains(t.text, e.original) GROUP BY t.doc_seq",
)
def text_with_group_map(spark, sf):
    """Texts joined to their group's map: how many known originals each one holds."""
    found = _ru_orders(spark, sf).entities.select("group_id", "original", "token")
    texts = C.corpus(spark, sf, C.RU_CLIENTS).select("group_id", "doc_seq", "text")
    hits = contain.occurrences(texts, found.withColumnRenamed("original", "needle"), ["group_id"])
    per = hits.groupBy("doc_seq").agg(F.count_distinct("token").alias("known"))
    return texts.join(per, "doc_seq", "left").select("doc_seq", F.coalesce("known", F.lit(0)).alias("known"))


@query(
    "span_with_entity",
    f"SELECT f.doc_seq, f.st, e.token FROM ({oracle.found(C.RU_ORDERS, oracle.RU_TYPES)}) f "
    f"JOIN ({_ENTITIES}) e ON e.group_id = f.group_id AND e.norm = f.norm",
)
def span_with_entity(spark, sf):
    found = _ru_orders(spark, sf).entities.select("group_id", "norm", "token")
    texts = C.corpus(spark, sf, C.RU_ORDERS)
    spans = detect.found_in(texts, KEY, lang="ru")
    return spans.join(found, ["group_id", "norm"]).select("doc_seq", "st", "token")


_RESOLVE = (
    f"WITH s AS ({C.SESSIONS}), r AS (SELECT ids, CAST(i - 1 AS INT) AS \"at\", l[i] AS id FROM (SELECT ids, l, "
    "unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT ids, list_filter(list_transform(string_split("
    f"replace(ids, chr(10), ','), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM ({C.REQUESTS})))), "
    "a AS (SELECT r.*, s.session_id FROM r JOIN s ON r.id = s.session_id), "
    "b AS (SELECT r.*, s.session_id FROM r LEFT JOIN s ON r.id = s.group_id "
    "WHERE r.id NOT IN (SELECT id FROM a)), "
    "x AS (SELECT * FROM a UNION ALL SELECT * FROM b) "
)


@query("resolve_identifiers", _RESOLVE + 'SELECT ids, "at", id, session_id FROM x')
def resolve_identifiers(spark, sf):
    """Each identifier as a session first, else as a group."""
    return sessions.resolve(
        C.corpus(spark, sf, C.REQUESTS), "ids", C.corpus(spark, sf, C.SESSIONS)
    )


@query(
    "identifiers_not_found",
    _RESOLVE + "SELECT ids, CAST(count(session_id) AS BIGINT) AS sessions, "
    "CAST(CASE WHEN count(session_id) > 0 THEN 200 ELSE 404 END AS INT) AS status FROM x GROUP BY ids",
)
def identifiers_not_found(spark, sf):
    return sessions.resolve_status(
        C.corpus(spark, sf, C.REQUESTS), "ids", C.corpus(spark, sf, C.SESSIONS)
    )


def _session_table(spark, sf) -> DataFrame:
    """The derived sessions, encrypted, written and read back."""
    path = fresh_path(spark, "sessions")
    rows = C.corpus(spark, sf, C.SESSIONS).join(C.corpus(spark, sf, C.SESSION_TOKENS), "session_id")
    by = ["session_id", "group_id", "user_token", "filename", "lang", "created_at"]
    made = sessions.new_sessions(
        rows, by, SECRET, session_id=F.col("session_id"), group_id=F.col("group_id"),
        user_token=F.col("user_token"), filename=F.col("filename"), lang=F.col("lang"),
        created_at=F.col("created_at"),
    )
    # Some thousand days of a few rows each: years will do as partitions here.
    sessions.append_sessions(made.withColumn("created_date", F.trunc("created_date", "year")), path)
    return sessions.read_sessions(spark, path)


_MERGED = _RESOLVE + (
    f", t AS ({C.SESSION_TOKENS}) SELECT ids, t.token, arg_max(t.original, {{'a': \"at\", 'c': s.created_at, "
    "'s': s.session_id}) AS original FROM x JOIN s ON s.session_id = x.session_id "
    "JOIN t ON t.session_id = s.session_id GROUP BY ids, t.token"
)


@query("union_of_session_maps", _MERGED)
def union_of_session_maps(spark, sf):
    """The maps behind each identifier list, merged; later ones win."""
    return sessions.resolved_map(
        C.corpus(spark, sf, C.REQUESTS), "ids", _session_table(spark, sf), SECRET
    )


@query(
    "restore_by_identifiers",
    f"WITH m AS ({_MERGED}) SELECT req, ids, CASE WHEN p.original IS NULL THEN '<PRIORITY_1>' ELSE p.original END "
    "|| ', known: <NOTHING_1>' AS restored_text, CAST(CASE WHEN p.original IS NULL THEN 404 ELSE 200 END AS INT) AS status "
    f"FROM ({C.REQUESTS}) r LEFT JOIN (SELECT ids AS i, original FROM m WHERE token = '<PRIORITY_1>') p ON p.i = r.ids",
)
def restore_by_identifiers(spark, sf):
    """Texts restored by the identifier list each carries; 404 where none is known."""
    wanted = C.corpus(spark, sf, C.REQUESTS).withColumn("text", F.lit("<PRIORITY_1>, known: <NOTHING_1>"))
    back = jobs.restore(wanted, "text", "ids", _session_table(spark, sf), SECRET, ["req"], ttl_hours=None)
    return back.select("req", "ids", "restored_text", "status")


_HOURLY_MAPS = "SELECT md5(cast(o_orderkey as string)) AS session_id, o_orderkey AS seq, o_orderkey % 240 AS age FROM orders"


@query(
    "restore_within_ttl",
    "SELECT seq, CASE WHEN age <= 100 THEN 'see order ' || seq ELSE 'see <ORDER_' || seq || '>' END AS restored_text, "
    f"CAST(CASE WHEN age <= 100 THEN 200 ELSE 404 END AS INT) AS status FROM ({_HOURLY_MAPS})",
)
def restore_within_ttl(spark, sf):
    """Texts restored by sessions that are not too old; older ones are not known any more."""
    path = fresh_path(spark, "sessions")
    ages = C.corpus(spark, sf, _HOURLY_MAPS)
    used = ages.selectExpr("session_id", "age", "concat('<ORDER_', seq, '>') as token", "concat('order ', seq) as original")
    now = F.lit(_TTL_NOW).cast("timestamp")
    made = sessions.new_sessions(
        used, ["session_id", "age"], SECRET, session_id=F.col("session_id"),
        created_at=now - F.make_dt_interval(hours=F.col("age").cast("int")),
    )
    sessions.append_sessions(made.repartition("created_date"), path)
    texts = ages.selectExpr("seq", "session_id as ids", "concat('see <ORDER_', seq, '>') as text")
    back = jobs.restore(texts, "text", "ids", sessions.read_sessions(spark, path), SECRET, ["seq"], now=now, ttl_hours=100)
    return back.select("seq", "restored_text", "status")


@query(
    "redaction_boxes",
    "WITH o AS (SELECT doc_id AS page, i - 1 AS word_no, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, "
    "len(ws) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))), "
    "s AS (SELECT doc_id AS page, lower(split_part(text, ' ', 2)) AS s FROM documents "
    "WHERE length(split_part(text, ' ', 2)) > 2) "
    "SELECT o.page, CAST(o.word_no AS INT) AS word_no, o.word FROM o JOIN s ON o.page = s.page "
    "WHERE trim(o.word) <> '' AND (contains(lower(trim(o.word)), s.s) OR contains(s.s, lower(trim(o.word))))",
)
def redaction_boxes(spark, sf):
    """Words of a page that hold a sensitive word or lie in one."""
    docs = C.table(spark, sf, "documents")
    words = docs.select(
        F.col("doc_id").alias("page"), F.posexplode(F.split("text", " ")).alias("word_no", "word")
    )
    sensitive = docs.select(
        F.col("doc_id").alias("page"), F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("word")
    ).where(F.length("word") > boxes.MIN_PART)
    return boxes.redaction_boxes(words, sensitive, ["page"]).select("page", "word_no", "word")


@query(
    "contained_words",
    "WITH n AS (SELECT DISTINCT p_size AS g, p_name AS needle FROM part), "
    "h AS (SELECT DISTINCT p_size AS g, p_name || ' ' || p_type AS hay FROM part) "
    "SELECT n.g, needle, hay FROM n JOIN h ON n.g = h.g AND contains(hay, needle)",
)
def contained_words(spark, sf):
    """Which strings of a scope lie inside which others."""
    parts = C.table(spark, sf, "part")
    needles = parts.selectExpr("p_size as g", "p_name as needle").distinct()
    hays = parts.selectExpr("p_size as g", "concat(p_name, ' ', p_type) as hay").distinct()
    return contain.contained_in(needles, hays, ["g"])


@query(
    "originals_on_pages",
    f"WITH e AS ({_ENTITIES}), p AS ({C.RU_ORDERS}) SELECT p.doc_seq, e.token, "
    "CAST(strpos(p.text, e.original) - 1 AS INT) AS st FROM p JOIN e ON p.group_id = e.group_id "
    "AND contains(p.text, e.original)",
)
def originals_on_pages(spark, sf):
    """Where known originals stand on a page, and the token to print there."""
    found = _ru_orders(spark, sf).entities
    pages = C.corpus(spark, sf, C.RU_ORDERS).select("group_id", "doc_seq", "text")
    return boxes.page_hits(pages, found, ["group_id"]).select("doc_seq", "token", "st")


@query(
    "department_labels",
    "SELECT c_custkey AS user_id, coalesce(n_name, CAST(dept AS VARCHAR)) AS department FROM (SELECT c_custkey, "
    "CASE WHEN c_custkey % 5 = 0 THEN 1000 + c_nationkey ELSE c_nationkey END AS dept FROM customer) "
    "LEFT JOIN nation ON n_nationkey = dept",
)
def department_labels(spark, sf):
    """A user's department by name, or its bare key where it has none."""
    users = C.table(spark, sf, "customer").selectExpr(
        "c_custkey as user_id", "if(c_custkey % 5 = 0, 1000 + c_nationkey, c_nationkey) as dept"
    )
    labels = C.table(spark, sf, "nation").selectExpr("n_nationkey as dept", "n_name")
    return users.join(labels, "dept", "left").select(
        "user_id", F.coalesce("n_name", F.col("dept").cast("string")).alias("department")
    )


# --- Aggregates, order, sets -----------------------------------------------------------


@query(
    "distinct_hidden_values",
    f"SELECT group_id, CAST(count(DISTINCT v) AS BIGINT) AS hidden FROM ({oracle.found(C.RU_ORDERS, oracle.RU_TYPES)}) "
    "GROUP BY group_id",
)
def distinct_hidden_values(spark, sf):
    texts = C.corpus(spark, sf, C.RU_ORDERS)
    found = detect.found_in(texts, KEY, lang="ru")
    # Distinct first, so a busy group is counted by many tasks.
    return found.select("group_id", "v").distinct().groupBy("group_id").agg(
        F.count(F.lit(1)).alias("hidden")
    )


@query(
    "entities_per_session",
    f"SELECT session_id, CAST(count(*) AS BIGINT) AS entities FROM ({C.SESSION_TOKENS}) GROUP BY session_id",
)
def entities_per_session(spark, sf):
    tokens = C.corpus(spark, sf, C.SESSION_TOKENS)
    return tokens.groupBy("session_id").agg(F.count(F.lit(1)).alias("entities"))


@query(
    "group_map_as_json",
    f"WITH s AS ({C.SESSIONS}), t AS ({C.SESSION_TOKENS}), m AS (SELECT s.group_id, t.token, arg_max(t.original, "
    "{'a': s.created_at, 'b': s.session_id}) AS original FROM s JOIN t ON s.session_id = t.session_id "
    "WHERE s.group_id IS NOT NULL GROUP BY ALL) "
    "SELECT group_id, '{' || string_agg('\"' || token || '\":\"' || original || '\"', ',' ORDER BY token) || '}' AS map "
    "FROM m GROUP BY group_id",
)
def group_map_as_json(spark, sf):
    """The merged map of each group as one value."""
    merged = sessions.group_map(_session_tokens(spark, sf))
    maps = restoring.scope_maps(merged, ["group_id"])
    ordered = F.map_from_entries(F.array_sort(F.map_entries("token_map")))
    return maps.select("group_id", crypto.encode_map(ordered).alias("map"))


_HITS = (
    f"SELECT 'ru' AS text_lang, ty FROM ({oracle.found(C.RU_CLIENTS, oracle.RU_TYPES)}) UNION ALL "
    f"SELECT 'en', ty FROM ({oracle.found(C.EN_CLIENTS, oracle.IN_TYPES)})"
)


@query(
    "scan_report",
    f"SELECT text_lang, ty, CAST(count(*) AS BIGINT) AS hits FROM ({_HITS}) GROUP BY text_lang, ty",
)
def scan_report(spark, sf):
    """Hits by language and type, without masking."""
    return jobs.scan_report(C.corpus(spark, sf, _FAMILY))


@query(
    "scan_report_totals",
    f"SELECT text_lang, ty, CAST(count(*) AS BIGINT) AS hits FROM ({_HITS}) GROUP BY ROLLUP(text_lang, ty)",
)
def scan_report_totals(spark, sf):
    report = jobs.scan_report(C.corpus(spark, sf, _FAMILY))
    return report.rollup("text_lang", "ty").agg(F.sum("hits").alias("hits"))


@query(
    "sessions_newest_first",
    f"SELECT session_id, group_id, filename, created_at, CAST(2 AS INT) AS entities_count FROM ({C.SESSIONS}) "
    "WHERE user_token = 'user-3'",
)
def sessions_newest_first(spark, sf):
    return sessions.sessions(_session_table(spark, sf), "user-3")


@query(
    "tokens_longest_first",
    "SELECT c_custkey AS k, array_to_string(list_transform(list_sort(list_transform([c_name, c_mktsegment, "
    "CAST(c_nationkey AS VARCHAR)], lambda x: {'l': -length(x), 'x': x})), lambda s: s.x), '|') AS ordered FROM customer",
)
def tokens_longest_first(spark, sf):
    longest = (
        "array_join(transform(array_sort(transform(array(c_name, c_mktsegment, cast(c_nationkey as string)), "
        "x -> named_struct('l', -length(x), 'x', x))), s -> s.x), '|')"
    )
    return _expr(C.table(spark, sf, "customer"), k="c_custkey", ordered=longest)


@query(
    "selected_scopes",
    "SELECT o_custkey AS who, string_agg(scope, ', ' ORDER BY scope) AS scopes FROM (SELECT DISTINCT o_custkey, "
    "coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'grp-' || (o_orderkey % 4) END, md5(CAST(o_orderkey AS VARCHAR))) AS scope "
    "FROM orders) GROUP BY o_custkey",
)
def selected_scopes(spark, sf):
    """The distinct scopes a user has picked, as one list."""
    picked = C.table(spark, sf, "orders").selectExpr(
        "o_custkey as who",
        "coalesce(if(o_orderkey % 2 = 0, concat('grp-', o_orderkey % 4), null), "
        "md5(cast(o_orderkey as string))) as scope",
    )
    return picked.distinct().groupBy("who").agg(
        F.array_join(F.array_sort(F.collect_list("scope")), ", ").alias("scopes")
    )


# --- Encryption, sessions, audit -----------------------------------------------------------


@query(
    "map_encrypted_and_back",
    f"SELECT s.session_id, t.token, t.original FROM ({C.SESSIONS}) s JOIN ({C.SESSION_TOKENS}) t "
    "ON s.session_id = t.session_id",
)
def map_encrypted_and_back(spark, sf):
    tokens = sessions.tokens_of(_session_table(spark, sf), SECRET)
    return tokens.select("session_id", "token", "original")


@query(
    "map_stored_in_clear",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE 1 END AS entries, "
    "o_orderkey % 3 <> 2 AS readable FROM orders",
)
def map_stored_in_clear(spark, sf):
    """Encrypted and clear maps are read; an unreadable one is empty and told apart."""
    m = F.create_map(F.lit("<A_1>"), F.col("o_orderpriority"))
    rows = C.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderkey") % 3 == 0, crypto.encrypt_map(m, SECRET))
        .when(F.col("o_orderkey") % 3 == 1, crypto.encode_map(m).cast("binary"))
        .otherwise(F.lit("neither").cast("binary"))
        .alias("stored"),
    )
    return rows.select(
        "k",
        F.size(crypto.decrypt_map(F.col("stored"), SECRET)).alias("entries"),
        crypto.readable(F.col("stored"), SECRET).alias("readable"),
    )


@query(
    "map_as_json",
    "SELECT o_orderkey AS k, '{\"<ORDER_' || o_orderkey || '>\":\"' || o_orderpriority || '\"}' AS json, "
    "o_orderpriority AS back FROM orders",
)
def map_as_json(spark, sf):
    m = F.create_map(F.expr("concat('<ORDER_', o_orderkey, '>')"), F.col("o_orderpriority"))
    rows = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), crypto.encode_map(m).alias("json"))
    return rows.select("k", "json", F.map_values(crypto.decode_map(F.col("json")))[0].alias("back"))


@query(
    "session_append",
    f"SELECT session_id, group_id, user_token, filename, CAST(2 AS INT) AS entities_count, lang, created_at "
    f"FROM ({C.SESSIONS})",
)
def session_append(spark, sf):
    return _session_table(spark, sf).drop("entity_map_enc", "created_date")


# Sessions of ten days; those of the last hundred hours live.
_HOURLY = (
    "SELECT md5(cast(o_orderkey as string)) AS session_id, o_orderkey AS seq, "
    f"TIMESTAMP '{_TTL_NOW}' - cast(o_orderkey % 240 as int) * INTERVAL '1' HOUR AS created_at FROM orders"
)


@query("sessions_expire", f"SELECT session_id FROM ({_HOURLY}) WHERE created_at >= TIMESTAMP '{_TTL_NOW}' - INTERVAL 100 HOURS")
def sessions_expire(spark, sf):
    """Sessions older than their time to live are deleted from the table."""
    path = fresh_path(spark, "sessions")
    none = F.lit(None).cast("string")
    rows = C.corpus(spark, sf, _HOURLY).select(
        "session_id", none.alias("group_id"), F.lit("u").alias("user_token"), none.alias("filename"),
        none.cast("binary").alias("entity_map_enc"), F.lit(0).alias("entities_count"), F.lit("ru").alias("lang"),
        "created_at", F.to_date("created_at").alias("created_date"),
    )
    sessions.append_sessions(rows.repartition("created_date"), path)
    now = F.lit(_TTL_NOW).cast("timestamp")
    sessions.expire(spark, path, now, 100)
    return sessions.read_sessions(spark, path).select("session_id")


@query(
    "audit_events",
    "SELECT m.doc_seq, 'user-00000...' AS token, 'ANONYMIZED_REQUEST' AS action, "
    "CAST(m.map_size AS BIGINT) AS hidden_entities_count, CASE WHEN length(m.masked_text) > 150 "
    "THEN substr(m.masked_text, 1, 150) || '...' ELSE m.masked_text END AS original_text_preview "
    f"FROM ({_MASKED_ORDERS}) m",
)
def audit_events(spark, sf):
    """Audit lines, written as JSON and read back."""
    done = _ru_orders(spark, sf)
    texts = done.masked.withColumn("user_token", F.lit("user-00000-of-the-house"))
    path = fresh_path(spark, "audit")
    sinks.append_audit(jobs.audit(texts, done.used, KEY, keep=["doc_seq"]), path)
    back = spark.read.schema(
        "doc_seq bigint, timestamp string, token string, action string, "
        "hidden_entities_count bigint, original_text_preview string"
    ).json(path)
    return back.drop("timestamp")


# --- Sources and sinks ------------------------------------------------------------------


def _written(df: DataFrame, label: str, how: str, **options) -> str:
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).format(how).save(path)
    return path


_CELLS = (
    "SELECT c_custkey AS k, cast(c_nationkey as string) AS group_id, c_name AS name, "
    f"{C._CLIENT} AS note, c_acctbal AS \"Salary amount\", c_mktsegment AS segment FROM customer"
)
# The only cell with identifiers is the note; c_name holds a nine-digit number too.
_CELL_UNITS = (
    f"SELECT cast(c_nationkey as string) AS group_id, c_custkey AS doc_seq, 1 AS unit_no, {C._CLIENT} AS text "
    "FROM customer UNION ALL SELECT cast(c_nationkey as string), c_custkey, 0, c_name FROM customer "
    "UNION ALL SELECT cast(c_nationkey as string), c_custkey, 2, c_mktsegment FROM customer"
)
_MASKED_CELLS = oracle.masked(_CELL_UNITS, oracle.RU_TYPES)
_CELLS_SQL = (
    f"WITH m AS (SELECT * FROM ({_MASKED_CELLS})) SELECT a.doc_seq AS k, a.masked_text AS name, b.masked_text AS note, "
    "c.masked_text AS segment FROM m a JOIN m b ON a.doc_seq = b.doc_seq AND a.unit_no = 0 AND b.unit_no = 1 "
    "JOIN m c ON a.doc_seq = c.doc_seq AND c.unit_no = 2"
)


def _cells(spark, sf) -> DataFrame:
    return C.table(spark, sf, "customer").selectExpr(
        "c_custkey as k", "cast(c_nationkey as string) as group_id", "c_name as name",
        f"{C._CLIENT} as note", "c_mktsegment as segment",
    )


_COLUMNS = ["k", "group_id", "name", "note", "segment"]


def _delimited(spark, sf, kind: str) -> DataFrame:
    """The cells written as one delimited file, read without a schema and masked."""
    sep = readers.SEPARATORS[kind]
    rows = _cells(spark, sf).select(
        F.lit("cells").alias("path"), F.lit(f"cells.{kind}").alias("filename"), F.col("k").alias("position"),
        delimited.line_of(F.array(*[F.col(c).cast("string") for c in _COLUMNS]), sep).alias("content"),
    )
    header = spark.range(1).selectExpr(
        "'cells' as path", f"'cells.{kind}' as filename", "-1L as position", f"'{sep.join(_COLUMNS)}' as content"
    )
    path = fresh_path(spark, "cells")
    sinks.write_files(rows.unionByName(header), path)
    cells = readers.read_cells(spark, path, sep).where(F.col("cells")[0] != "k")
    named = cells.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(_COLUMNS)])
    masked, _ = jobs.mask_table(named.withColumn("k", F.col("k").cast("bigint")), "k", "group_id", lang="ru")
    return masked.drop("group_id")


@query("csv_cells_masked", _CELLS_SQL)
def csv_cells(spark, sf):
    """Every cell of a CSV file, masked in one group per nation."""
    return _delimited(spark, sf, "csv")


@query("tsv_cells_masked", _CELLS_SQL)
def tsv_cells(spark, sf):
    return _delimited(spark, sf, "tsv")


@query(
    "csv_rows_with_header",
    "SELECT 'k' AS first, 'name' AS second UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name FROM customer",
)
def csv_rows_with_header(spark, sf):
    """A CSV file as rows of cells, the header row among them."""
    path = _written(_cells(spark, sf).select("k", "name"), "rows", "csv", header="true")
    cells = readers.read_cells(spark, path)
    rows = cells.select(F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))
    # Every part file has a header of its own.
    header = (F.col("first") == "k") & (F.col("second") == "name")
    return rows.where(~header).unionByName(rows.where(header).distinct())


@query(
    "spreadsheet_masked",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '<AADHAAR_IN_1>' ELSE '2500.0' END AS \"Salary amount\", "
    "o_totalprice AS price, o_orderpriority AS priority FROM orders",
)
def spreadsheet(spark, sf):
    """Numbers are masked under a sensitive header only."""
    sheet = C.table(spark, sf, "orders").selectExpr(
        "o_orderkey as k",
        "if(o_orderkey % 2 = 0, 123456789012, 2500) as `Salary amount`",
        "o_totalprice as price",
        "o_orderpriority as priority",
    )
    masked, _ = jobs.mask_table(sheet, "k", lang="en")
    return masked


_JSON_UNITS = (
    f"SELECT cast(c_nationkey as string) AS group_id, c_custkey AS doc_seq, 0 AS unit_no, {C._CLIENT} AS text FROM customer "
    "UNION ALL SELECT cast(c_nationkey as string), c_custkey, 1, concat('ИНН ', cast(7800000000 + c_custkey as string)) "
    "FROM customer"
)
_JSON_SQL = (
    f"WITH m AS (SELECT * FROM ({oracle.masked(_JSON_UNITS, oracle.RU_TYPES)})) SELECT a.doc_seq AS k, "
    "a.masked_text AS name, b.masked_text AS inner_text, CAST(a.doc_seq % 10 AS BIGINT) AS number "
    "FROM m a JOIN m b ON a.doc_seq = b.doc_seq AND a.unit_no = 0 AND b.unit_no = 1"
)


def _json_rows(spark, sf) -> DataFrame:
    return C.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"),
        F.col("c_nationkey").cast("string").alias("group_id"),
        F.struct(
            F.expr(C._CLIENT).alias("name"),
            F.struct(
                F.array(F.expr("concat('ИНН ', cast(7800000000 + c_custkey as string))")).alias("inner"),
                (F.col("c_custkey") % 10).alias("number"),
            ).alias("nested"),
        ).alias("doc"),
    )


@query("json_leaves_masked", _JSON_SQL)
def json_leaves(spark, sf):
    """Every string of a JSON source whose schema is known."""
    rows = _json_rows(spark, sf)
    path = _written(rows, "json", "json")
    docs = spark.read.schema(rows.schema).json(path)
    masked, _ = jobs.mask_rows(docs, leaves.row_strings(docs, ["doc"]), "k", "group_id", lang="ru")
    done = leaves.apply_changes(masked, ["doc"])
    return done.select(
        "k", F.col("doc.name").alias("name"), F.col("doc.nested.inner")[0].alias("inner_text"),
        F.col("doc.nested.number").alias("number"),
    )


@query("json_text_masked", _JSON_SQL)
def json_text(spark, sf):
    """JSON in a string column whose shape is not known."""
    rows = _json_rows(spark, sf).select("k", "group_id", F.to_json("doc").alias("props"))
    masked, _ = jobs.mask_rows(rows, leaves.json_strings(F.col("props")), "k", "group_id", lang="ru")
    done = masked.select("k", leaves.json_changed(F.col("props"), F.col("changes")).alias("props"))
    return done.select(
        "k",
        F.get_json_object("props", "$.name").alias("name"),
        F.get_json_object("props", "$.nested.inner[0]").alias("inner_text"),
        F.get_json_object("props", "$.nested.number").cast("bigint").alias("number"),
    )


@query(
    "xml_masked",
    f"WITH m AS (SELECT * FROM ({oracle.masked(_JSON_UNITS, oracle.RU_TYPES)})) SELECT a.doc_seq AS k, "
    "a.masked_text AS name, b.masked_text AS tax FROM m a JOIN m b ON a.doc_seq = b.doc_seq "
    "AND a.unit_no = 0 AND b.unit_no = 1",
)
def xml_masked(spark, sf):
    """XML rows by the built-in source: text and attribute values."""
    rows = C.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"),
        F.col("c_nationkey").cast("string").alias("group_id"),
        F.expr(C._CLIENT).alias("name"),
        F.expr("concat('ИНН ', cast(7800000000 + c_custkey as string))").alias("_tax"),
    )
    # A file of XML is read by one task, so the rows are dealt out over many.
    path = _written(spread(rows), "xml", "xml", rowTag="client")
    read = spark.read.schema(rows.schema).option("rowTag", "client").format("xml").load(path)
    strings = F.array("name", "_tax")
    masked, _ = jobs.mask_rows(read, strings, "k", "group_id", lang="ru")
    done = leaves.apply_changes(masked, ["name", "_tax"])
    return done.select("k", "name", F.col("_tax").alias("tax"))


@query(
    "html_text_masked",
    "SELECT page_id, string_agg(CASE WHEN i <= len(p) THEN regexp_replace(p[i], "
    "'[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\\.)+[A-Za-z]{2,24}', '<EMAIL>', 'g') ELSE '' END || "
    "CASE WHEN i <= len(t) THEN t[i] ELSE '' END, '' ORDER BY i) AS masked FROM (SELECT *, "
    "unnest(range(1, len(p) + 2)) AS i FROM (SELECT page_id, string_split_regex(h, '<[^>]*>') AS p, "
    "regexp_extract_all(h, '<[^>]*>') AS t FROM (SELECT page_id, replace(html, '</p>', "
    "' write to u' || page_id || '@mail.example</p>') AS h FROM pages))) GROUP BY page_id",
)
def html_text(spark, sf):
    """Text between tags is rewritten, the tags stay as they are."""
    pages = C.table(spark, sf, "pages").selectExpr(
        "page_id",
        "replace(html, '</p>', concat(' write to u', page_id, '@mail.example</p>')) as html",
    )
    mail = detect.pattern_spans("part", P.SECOND_PASS[0])
    pieces = f"transform({mail}, s -> named_struct('st', s.st, 'ln', s.ln, 'rep', '<EMAIL>'))"
    parts = F.expr(f"transform(parts, part -> {S.splice('part', pieces)})")
    cut = pages.select(
        "page_id", html.text_parts(F.col("html")).alias("parts"), html.tags(F.col("html")).alias("tags")
    )
    return cut.select("page_id", html.reassemble(parts, F.col("tags")).alias("masked"))


@query("html_pages_masked")
def html_pages(spark, sf):
    """Pages masked with tokens and put together again."""
    pages = C.table(spark, sf, "pages")
    masked, _ = jobs.mask_rows(pages, html.text_parts(F.col("html")), "page_id", lang="en")
    return masked.select("page_id", html.html_changed(F.col("html"), F.col("changes")).alias("masked"))


# What stands before, between and after the notes of a nation in a file of each kind.
_AROUND = {
    "txt": ("", "\n", ""),
    "json": ('["', '", "', '"]'),
    "xml": ("<r><p>", "</p><p>", "</p></r>"),
    "html": ("<html><p>", "</p>\n<p>", "</p></html>"),
}
_XML_HEAD = r"^<\?xml[^>]*>\s*"


def _nation_files(spark, sf) -> DataFrame:
    """path, filename, position, content: a file of every kind for each nation."""
    notes = C.table(spark, sf, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"),
        F.col("c_custkey").alias("k"),
        F.expr(C._CLIENT).alias("note"),
    )
    # A nation's notes are one file, which is one value.
    whole = notes.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "note")))["note"].alias("notes"))
    rows = [
        whole.select(
            "name", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("position"),
            F.concat(F.lit(before), F.array_join("notes", between), F.lit(after)).alias("content"),
        )
        for kind, (before, between, after) in _AROUND.items()
    ]
    rows += [
        notes.select(
            "name", F.lit(kind).alias("kind"), F.col("k").alias("position"),
            delimited.line_of(F.array(F.col("k").cast("string"), "note"), sep).alias("content"),
        )
        for kind, sep in readers.SEPARATORS.items()
    ]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    name = F.concat_ws(".", "name", "kind")
    return every.select(name.alias("path"), name.alias("filename"), "position", "content")


def _folder(spark, sf) -> str:
    """A folder with files of several kinds, written from the given tables."""
    path = fresh_path(spark, "folder")
    sinks.write_files(_nation_files(spark, sf), path)
    return path


def _nation_files_sql(source: str, markup: str = "note") -> str:
    """filename, content of the same files; ``source`` has g, k and note, ``markup`` is a note in XML and HTML."""
    parts = []
    for kind, (before, between, after) in _AROUND.items():
        note, sep = markup if kind in ("xml", "html") else "note", between.replace("\n", "' || chr(10) || '")
        parts.append(
            f"SELECT 'n' || g || '.{kind}' AS filename, '{before}' || string_agg({note}, '{sep}' ORDER BY k) || '{after}' "
            f"AS content FROM notes GROUP BY g"
        )
    parts.append("SELECT 'n' || g || '.csv', k || ',\"' || note || '\"' FROM notes")
    parts.append("SELECT 'n' || g || '.tsv', k || chr(9) || note FROM notes")
    return f"WITH notes AS MATERIALIZED ({source}) " + " UNION ALL ".join(parts)


_NOTES = f"SELECT c_nationkey AS g, c_custkey AS k, {C._CLIENT} AS note FROM customer"


@query("whole_files", "SELECT 'n' || c_nationkey || '.txt' AS filename, " + C._CLIENT + " AS line FROM customer")
def whole_files(spark, sf):
    """Text files read whole, line by line."""
    found = readers.read_whole(spark, _folder(spark, sf), "text")
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")
    return found.select(readers.name_of(F.col("path")).alias("filename"), F.explode(lines).alias("line"))


@query(
    "format_dispatch",
    "SELECT k, kind FROM (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'csv' "
    "WHEN 2 THEN 'json' WHEN 3 THEN 'container' WHEN 4 THEN 'html' WHEN 5 THEN 'not_built' WHEN 6 THEN 'xml' "
    "ELSE 'unknown' END AS kind FROM part)",
)
def format_dispatch(spark, sf):
    """Files by their lower-cased ending."""
    endings = "array('.MD', '.csv', '.Json', '.docx', '.HTM', '.pdf', '.mxl', '.exe')"
    named = C.table(spark, sf, "part").selectExpr(
        "p_partkey as k", f"concat('/in/', p_name, {endings}[cast(p_partkey % 8 as int)]) as path"
    )
    return named.select("k", readers.kind_of(F.col("path")).alias("kind"))


@query(
    "masked_output",
    f"SELECT group_id, doc_seq, 'safe_file' || doc_seq || '.txt' AS filename, masked_text FROM ({_MASKED_ORDERS})",
)
def masked_output(spark, sf):
    """Masked texts written by group and read back."""
    done = _ru_orders(spark, sf)
    path = fresh_path(spark, "out")
    named = F.concat(F.lit("file"), F.col("doc_seq").cast("string"), F.lit(".txt"))
    rows = done.masked.select("group_id", "doc_seq", T.masked_name(named).alias("filename"), "masked_text")
    # Rows of a group go together, in as many files as the group is large.
    sinks.write_masked(rows.hint("rebalance", "group_id"), path)
    schema = "doc_seq bigint, filename string, masked_text string, group_id string"
    return spark.read.schema(schema).parquet(path)


@query(
    "container_units",
    "SELECT '/in/doc' || doc_id || '.zip' AS path, 'doc' || doc_id || '.zip/' || m.member AS member, "
    "CAST(m.n AS INT) AS unit_no, m.kind, CASE WHEN m.kind = 'txt' THEN text ELSE m.reason END AS text FROM documents, "
    "(VALUES (0, 'inner/a.txt', 'txt', ''), (1, 'b.bin', 'error', 'format bin is not supported')) m(n, member, kind, reason)",
)
def container_units(spark, sf):
    """Text units out of archives that were made from the documents."""
    docs = C.table(spark, sf, "documents").select(
        F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), "text"
    )
    packed = docs.mapInPandas(_zipped, "path string, content binary")
    return readers.text_units(packed)


_MEMBERS = {
    "in/c.csv": "concat('k,note\n', cast(k as string), ',\"', note, '\"\n')",
    "in/t.tsv": "concat(cast(k as string), '\t', note, '\t\n')",
    "j.json": "concat('{\"n\": [\"', note, '\", 1]}')",
    "x.xml": "concat('<r a=\"', note, '\"><b>', cast(k as string), '</b></r>')",
    "in/h.html": "concat('<p>', note, '</p>')",
}
_MEMBER_STRINGS = {
    "in/c.csv": (["'k'", "'note'"], ["k", "m"]),
    "in/t.tsv": (["k", "m", "''"],),
    "j.json": (["m"],),
    "x.xml": (["m", "k"],),
    "in/h.html": (["''", "m", "''"],),
}


@query(
    "container_members_masked",
    "WITH m AS (SELECT doc_seq, regexp_replace(masked_text, '(<[A-Z_]+)_[0-9]+>', '\\1>', 'g') AS m, "
    f"CAST(doc_seq AS VARCHAR) AS k FROM ({oracle.masked(C.RU_CLIENTS, oracle.RU_TYPES)})) "
    + " UNION ALL ".join(
        f"SELECT doc_seq AS k, '{name}' AS member, CAST({i} AS BIGINT) AS position, "
        f"array_to_string([{', '.join(row)}], '|') AS strings FROM m"
        for name, rows in _MEMBER_STRINGS.items()
        for i, row in enumerate(rows)
    ),
)
def container_members_masked(spark, sf):
    """Members of archives masked by their own formats: cells, leaves, attributes, text parts."""
    notes = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.expr(C._CLIENT).alias("note"))
    members = F.create_map(*[x for name, sql in _MEMBERS.items() for x in (F.lit(name), F.expr(sql))])
    packed = notes.select(F.concat(F.lit("/in/"), "k", F.lit(".zip")).alias("path"), members.alias("members"))
    packed = spread(packed).mapInPandas(_zipped_members, "path string, content binary")
    rows, _ = readers.read_members(packed)
    rows = rows.withColumn("k", F.regexp_extract("path", r"(\d+)\.zip$", 1).cast("bigint"))
    # Rows of an archive in any order: the numbers of tokens are left out below.
    rows = staged(rows.withColumn("seq", F.monotonically_increasing_id()), "rows")
    masked, _ = jobs.mask_rows(rows.withColumn("g", F.lit("all")), F.col("leaves"), "seq", "g", lang="ru")
    done = F.transform("leaves", lambda x: F.coalesce(F.element_at("changes", x), x))
    return masked.select(
        "k",
        F.regexp_replace("member", r"^[^/]*/", "").alias("member"),
        "position",
        F.regexp_replace(F.array_join(done, "|"), "(<[A-Z_]+)_[0-9]+>", "$1>").alias("strings"),
    )


def _zipped_members(batches):
    import io
    import zipfile

    import pandas as pd

    for batch in batches:
        contents = []
        for members in batch["members"]:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, text in dict(members).items():
                    archive.writestr(name, text)
            contents.append(buffer.getvalue())
        yield pd.DataFrame({"path": batch["path"], "content": contents})


def _zipped(batches):
    import io
    import zipfile

    import pandas as pd

    for batch in batches:
        contents = []
        for text in batch["text"]:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as archive:
                archive.writestr("inner/a.txt", text)
                archive.writestr("b.bin", b"?")
            contents.append(buffer.getvalue())
        yield pd.DataFrame({"path": batch["path"], "content": contents})


# --- Jobs -------------------------------------------------------------------------------


@query("files_masked_and_restored", _nation_files_sql(_NOTES))
def files_masked_and_restored(spark, sf):
    """Files of every kind masked, written as files, read again and restored."""
    source, out, back = _folder(spark, sf), fresh_path(spark, "out"), fresh_path(spark, "back")
    done = files.mask_files(spark, source, f"{out}/masked", group_id="project", mode="tags", lang="ru")
    sinks.write_files(done.files, f"{out}/files")
    result = files.restore_files(spark, f"{out}/files", back, done.result.token_map, "project")
    content = F.regexp_replace(F.regexp_replace("content", _XML_HEAD, ""), r"\n\z", "")
    return result.files.select("filename", content.alias("content"))


_MASKED_NOTES = (
    "SELECT c_nationkey AS g, doc_seq AS k, regexp_replace(masked_text, '(<[A-Z_]+)_[0-9]+>', '\\1>', 'g') AS note FROM ("
    + oracle.masked(f"SELECT 'p' AS group_id, doc_seq, unit_no, text FROM ({C.RU_CLIENTS})", oracle.RU_TYPES)
    + ") JOIN customer ON c_custkey = doc_seq"
)


@query(
    "folder_masked",
    "SELECT 'safe_' || filename AS filename, content FROM ("
    + _nation_files_sql(_MASKED_NOTES, "replace(replace(note, '<', '&lt;'), '>', '&gt;')")
    + ")",
)
def folder_masked(spark, sf):
    """A folder with files of every kind, masked; the numbers of tokens are left out."""
    done = files.mask_files(spark, _folder(spark, sf), fresh_path(spark, "out"), group_id="p", mode="tags", lang="ru")
    unnumbered = F.regexp_replace("content", "((?:<|&lt;)[A-Z_]+)_[0-9]+(>|&gt;)", "$1$2")
    content = F.regexp_replace(F.regexp_replace(unnumbered, _XML_HEAD, ""), r"\n\z", "")
    return done.files.select("filename", content.alias("content"))


_ONE_GROUP = f"SELECT 'batch' AS group_id, doc_seq, unit_no, text FROM ({C.RU_CLIENTS})"


@query(
    "batch_under_one_group",
    f"SELECT doc_seq, masked_text FROM ({oracle.masked(_ONE_GROUP, oracle.RU_TYPES)})",
)
def batch_under_one_group(spark, sf):
    """All texts in one group, numbered in their order."""
    texts = C.corpus(spark, sf, C.RU_CLIENTS).drop("group_id")
    _, done = jobs.mask_batch(texts, "batch", unit="unit_no", lang="ru")
    return done.masked.select("doc_seq", "masked_text")


@query(
    "project_over_two_runs",
    f"SELECT doc_seq, text AS restored_text FROM ({C.RU_CLIENTS})",
)
def project_over_two_runs(spark, sf):
    """A project masks two batches with one token map, kept encrypted, and restores."""
    project = jobs.Project(spark, "project", fresh_path(spark, "project"), SECRET)
    texts = C.corpus(spark, sf, C.RU_CLIENTS).drop("group_id")
    first = project.mask(texts.where("doc_seq % 2 = 0"), lang="ru")
    second = project.mask(texts.where("doc_seq % 2 <> 0"), lang="ru")
    masked = first.unionByName(second).drop("text")
    back = project.restore(masked, "masked_text", ["doc_seq", "unit_no"])
    return back.select("doc_seq", "restored_text")


@query("table_masked", _CELLS_SQL)
def table_masked(spark, sf):
    """All string columns of a table."""
    masked, _ = jobs.mask_table(_cells(spark, sf), "k", "group_id", lang="ru")
    return masked.drop("group_id")


_NESTED_UNITS = (
    "SELECT cast(c_nationkey as string) AS group_id, c_custkey AS doc_seq, 0 AS unit_no, c_name AS text FROM customer "
    f"UNION ALL SELECT cast(c_nationkey as string), c_custkey, 1, {C._CLIENT} FROM customer "
    "UNION ALL SELECT cast(c_nationkey as string), c_custkey, 2, concat('ИНН ', cast(7800000000 + c_custkey as string)) FROM customer"
)


def _nested(spark, sf) -> DataFrame:
    """A table with strings in a struct, an array of structs and a map, and a long number under a sensitive header."""
    return C.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"),
        F.col("c_nationkey").cast("string").alias("group_id"),
        F.struct(F.col("c_name").alias("name"), F.lit(5).alias("n")).alias("who"),
        F.array(F.struct(F.expr(C._CLIENT).alias("note")), F.struct(F.lit(None).cast("string").alias("note"))).alias("notes"),
        F.create_map(F.lit("ИНН 7800000000"), F.expr("concat('ИНН ', cast(7800000000 + c_custkey as string))")).alias("tags"),
        F.expr("cast(9007199254740993 as decimal(38,0))").alias("bonus"),
    )


@query(
    "table_nested_masked",
    f"WITH m AS (SELECT * FROM ({oracle.masked(_NESTED_UNITS, oracle.RU_TYPES)})) SELECT a.doc_seq AS k, a.masked_text AS name, "
    "5 AS n, b.masked_text AS note, 'ИНН 7800000000' AS tag_key, c.masked_text AS tag, '9007199254740993' AS bonus FROM m a "
    "JOIN m b ON a.doc_seq = b.doc_seq AND a.unit_no = 0 AND b.unit_no = 1 JOIN m c ON a.doc_seq = c.doc_seq AND c.unit_no = 2",
)
def table_nested_masked(spark, sf):
    """Strings inside structs, arrays and maps; keys and other values stay, no digit is lost."""
    masked, _ = jobs.mask_table(_nested(spark, sf), "k", "group_id", lang="ru")
    return masked.select(
        "k", "who.name", "who.n", F.col("notes")[0]["note"].alias("note"), F.map_keys("tags")[0].alias("tag_key"),
        F.map_values("tags")[0].alias("tag"), "bonus",
    )


@query(
    "table_nested_restored",
    f"SELECT c_custkey AS k, c_name AS name, {C._CLIENT} AS note, 'ИНН ' || (7800000000 + c_custkey) AS tag FROM customer",
)
def table_nested_restored(spark, sf):
    masked, done = jobs.mask_table(_nested(spark, sf), "k", "group_id", lang="ru")
    back = jobs.restore_table(staged(masked, "table"), "k", done.token_map, "group_id")
    return back.select("k", "who.name", F.col("notes")[0]["note"].alias("note"), F.map_values("tags")[0].alias("tag"))


@query(
    "table_restored",
    f"SELECT c_custkey AS k, c_name AS name, {C._CLIENT} AS note, c_mktsegment AS segment FROM customer",
)
def table_restored(spark, sf):
    masked, done = jobs.mask_table(_cells(spark, sf), "k", "group_id", lang="ru")
    back = jobs.restore_table(staged(masked, "table"), "k", done.token_map, "group_id")
    return back.drop("group_id")


# --- Streaming ----------------------------------------------------------------------------


def _stream(spark, rows: DataFrame, batches: int = 3) -> DataFrame:
    """A table written as files and read as a stream, as many files at a time as there are cores."""
    path = fresh_path(spark, "stream")
    cores = spark.sparkContext.defaultParallelism
    rows.repartition(batches * cores).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", cores).parquet(path)


def _finish(running) -> None:
    running.awaitTermination()


@query(
    "stream_detection",
    f"SELECT doc_seq, pass, st, ty, v FROM ({oracle.found(C.RU_CLIENTS, oracle.RU_TYPES)})",
)
def stream_detection(spark, sf):
    rows = C.corpus(spark, sf, C.RU_CLIENTS)
    hits = streaming.hits(_stream(spark, rows), ["doc_seq"], lang="ru")
    hits = hits.select("doc_seq", "pass", "st", "ty", "v")
    out = fresh_path(spark, "stream-out")
    _finish(streaming.to_table(hits, out, fresh_path(spark, "stream-state")))
    return spark.read.schema(hits.schema).parquet(out)


_STREAM_BATCHES = 3


def _in_order(spark, rows: DataFrame, by: str, start) -> None:
    """Feed a stream in the order of ``by``: each stretch arrives, and is then taken.

    ``start`` begins the same stream again, from its checkpoint.
    """
    path = fresh_path(spark, "stream")
    low, high = rows.agg(F.min(by), F.max(by)).first()
    step = (high - low) / _STREAM_BATCHES
    for i in range(_STREAM_BATCHES):
        upper = F.col(by) < F.lit(low + step * (i + 1)) if i < _STREAM_BATCHES - 1 else F.lit(True)
        rows.where((F.col(by) >= F.lit(low + step * i)) & upper).write.mode("append").parquet(path)
        _finish(start(spark.readStream.schema(rows.schema).parquet(path)))


@query("stream_masking", f"SELECT doc_seq, masked_text FROM ({oracle.masked(C.RU_CLIENTS, oracle.RU_TYPES)})")
def stream_masking(spark, sf):
    """Tokens kept over micro-batches, and sessions and audit lines written."""
    rows = C.corpus(spark, sf, C.RU_CLIENTS)
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")

    def start(stream):
        return streaming.masked_stream(
            stream, out, state, lang="ru", secret=SECRET,
            sessions=f"{out}/sessions", audits=f"{out}/audit",
        )

    _in_order(spark, rows, "doc_seq", start)
    return spark.read.parquet(f"{out}/masked").select("doc_seq", "masked_text")


@query(
    "stream_sessions_and_audit",
    "WITH m AS (SELECT group_id, doc_seq, map_size, masked_text FROM "
    f"({oracle.masked(C.RU_CLIENTS, oracle.RU_TYPES)})) "
    "SELECT 'session' AS kind, group_id AS who, CAST(map_size AS BIGINT) AS hidden, NULL AS preview FROM m UNION ALL "
    "SELECT 'audit', group_id || '...', map_size, CASE WHEN length(masked_text) > 150 THEN substr(masked_text, 1, 150) || '...' "
    "ELSE masked_text END FROM m",
)
def stream_sessions_and_audit(spark, sf):
    """Sessions and audit lines of a stream, batch by batch."""
    rows = C.corpus(spark, sf, C.RU_CLIENTS)
    out = fresh_path(spark, "stream-out")
    _finish(
        streaming.masked_stream(
            _stream(spark, rows, 1), out, fresh_path(spark, "stream-state"), lang="ru", secret=SECRET,
            sessions=f"{out}/sessions", audits=f"{out}/audit",
        )
    )
    made = sinks.read_batches(spark, f"{out}/sessions", sessions.SCHEMA).select(
        F.lit("session").alias("kind"), F.col("group_id").alias("who"),
        F.col("entities_count").cast("bigint").alias("hidden"), F.lit(None).cast("string").alias("preview"),
    )
    lines = sinks.read_batches(
        spark, f"{out}/audit", "token string, hidden_entities_count bigint, original_text_preview string", "json"
    )
    return made.unionByName(
        lines.select(
            F.lit("audit").alias("kind"), F.col("token").alias("who"), F.col("hidden_entities_count").alias("hidden"),
            F.col("original_text_preview").alias("preview"),
        )
    )


@query("stream_group_expiry")
def stream_group_expiry(spark, sf):
    """Values of a group are forgotten when they are older than the time to live."""
    orders = C.corpus(spark, sf, C.RU_ORDERS).join(
        C.table(spark, sf, "orders").selectExpr(
            "o_orderkey as doc_seq", "cast(o_orderdate as timestamp) as at"
        ),
        "doc_seq",
    )
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")

    def start(stream):
        return streaming.masked_stream(stream, out, state, lang="ru", at="at", ttl="24 hours")

    _in_order(spark, orders, "at", start)
    return spark.read.parquet(f"{out}/entities").select("group_id", "norm", "token", "seen_at")


@query("stream_late_messages", "SELECT CAST(count(*) AS BIGINT) AS messages FROM events")
def stream_late_messages(spark, sf):
    """Late messages go to a table of their own; none is lost."""
    # Every fiftieth event comes a month after its time.
    events = C.table(spark, sf, "events").selectExpr(
        "event_id", "cast(ts as timestamp) as ts",
        "cast(ts as timestamp) + if(event_id % 50 = 0, interval '30' day, interval '0' day) as arrived",
    )
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")

    def start(stream):
        return streaming.late_to_quarantine(stream, "ts", "1 hour", out, state)

    _in_order(spark, events, "arrived", start)
    parts = spark.read.parquet(f"{out}/on_time").unionByName(spark.read.parquet(f"{out}/late"))
    return parts.agg(F.count(F.lit(1)).alias("messages"))


@query("stream_restoring", _spelled_once(C.RU_CLIENTS))
def stream_restoring(spark, sf):
    """A stream of masked replies restored against the entity table."""
    texts = C.corpus(spark, sf, C.RU_CLIENTS)
    done = jobs.mask(texts, group="group_id", unit="unit_no", lang="ru")
    replies = done.masked.select("group_id", "doc_seq", F.col("masked_text").alias("reply"))
    out = fresh_path(spark, "stream-out")
    _finish(
        streaming.restored_stream(
            _stream(spark, replies), done.token_map, out, fresh_path(spark, "stream-state"), text="reply"
        )
    )
    return spark.read.parquet(out).select("group_id", "doc_seq", "restored_text")


@query("stream_hits_per_hour")
def stream_hits_per_hour(spark, sf):
    """Hits per hour and type; the last open windows stay in the state."""
    events = C.table(spark, sf, "events").selectExpr(
        "cast(ts as timestamp) as ts", "concat('user', user_id, '@host.example did ', event_type) as text"
    )
    found = streaming.hits(_stream(spark, events, 1), ["ts"], lang="en")
    hourly = streaming.hits_per_window(found, "ts")
    out = fresh_path(spark, "stream-out")
    _finish(streaming.to_table(hourly, out, fresh_path(spark, "stream-state")))
    return spark.read.schema(hourly.schema).parquet(out)


# --- Described in the design note only --------------------------------------------------------


@query(
    "usage_quota",
    "SELECT event_id, user_id, strftime(ts, '%Y-%m') AS period, round(sum(value) OVER (PARTITION BY user_id, "
    "strftime(ts, '%Y-%m') ORDER BY ts, event_id), 4) AS used, round(sum(value) OVER (PARTITION BY user_id, "
    "strftime(ts, '%Y-%m') ORDER BY ts, event_id), 4) > 500 AS blocked FROM (SELECT event_id, user_id, ts, "
    "CAST(round(value * 100) AS DECIMAL(18,0)) / 100 AS value FROM events)",
)
def usage_quota(spark, sf):
    """Use so far per user and month, and whether it is over the limit."""
    events = C.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    cents = F.round(F.col("value") * 100).cast("decimal(18,0)")
    rows = quota.with_quota(events, "user_id", "ts", cents, 500 * 100, "event_id")
    return rows.select(
        "event_id", "user_id", "period", F.round(F.col("used").cast("double") / 100, 4).alias("used"), "blocked"
    )


_TERMS = ["the", "and", "erat"]
_BM25 = (
    "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), "
    "c AS (SELECT doc_id, len(ws) AS dl, "
    + ", ".join(f"len(list_filter(ws, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
    + " FROM w), s AS (SELECT count(*) AS n, avg(dl) AS a, "
    + ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(_TERMS)))
    + " FROM c), r AS (SELECT doc_id, "
    + " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / a))"
        for i in range(len(_TERMS))
    )
    + " AS score FROM c, s WHERE "
    + " OR ".join(f"tf{i} > 0" for i in range(len(_TERMS)))
    + ") "
)


@query(
    "lexical_retrieval",
    _BM25 + "SELECT doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT doc_id, score, row_number() OVER "
    "(ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 20",
)
def lexical_retrieval(spark, sf):
    scored = retrieval.bm25(C.table(spark, sf, "documents"), _TERMS)
    best = retrieval.top(scored, 20, "doc_id")
    return best.select("doc_id", "rank", F.round("score", 6).alias("score"))


def _query_vector(spark, sf) -> list[float]:
    """The vector of one given item; it is the question."""
    return C.table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


_COSINE = (
    "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, "
    "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(e[i] AS DOUBLE))) / "
    "(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * "
    "sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS score FROM embeddings, q) "
)


@query(
    "dense_retrieval",
    _COSINE + "SELECT vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT vec_id, score, row_number() OVER "
    "(ORDER BY score DESC, vec_id) AS rank FROM v) WHERE rank <= 20",
)
def dense_retrieval(spark, sf):
    vectors = C.table(spark, sf, "embeddings")
    scored = vectors.select(
        "vec_id", retrieval.cosine(F.col("embedding"), _query_vector(spark, sf)).alias("score")
    )
    best = retrieval.top(scored, 20, "vec_id")
    return best.select("vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    "hybrid_retrieval",
    _BM25
    + ", "
    + _COSINE.removeprefix("WITH ")
    + ", a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r), "
    "b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM v) "
    "SELECT id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM "
    "(SELECT * FROM a WHERE rank <= 50) a FULL OUTER JOIN (SELECT * FROM b WHERE rank <= 50) b USING (id)",
)
def hybrid_retrieval(spark, sf):
    words = retrieval.top(retrieval.bm25(C.table(spark, sf, "documents"), _TERMS), 50, "doc_id")
    vectors = C.table(spark, sf, "embeddings").select(
        "vec_id", retrieval.cosine(F.col("embedding"), _query_vector(spark, sf)).alias("score")
    )
    dense = retrieval.top(vectors, 50, "vec_id")
    both = retrieval.fused(
        words.withColumnRenamed("doc_id", "id"), dense.withColumnRenamed("vec_id", "id"), "id"
    )
    return both.select("id", F.round("score", 9).alias("score"))


@query(
    "answer_reused",
    _COSINE + "SELECT vec_id, round(score, 6) AS score FROM v WHERE vec_id <> 0 AND score >= 0.2 "
    "ORDER BY score DESC, vec_id LIMIT 1",
)
def answer_reused(spark, sf):
    """The most similar earlier question, if it is similar enough."""
    scored = C.table(spark, sf, "embeddings").where("vec_id <> 0").select(
        "vec_id", retrieval.cosine(F.col("embedding"), _query_vector(spark, sf)).alias("score")
    )
    best = retrieval.top(scored.where("score >= 0.2"), 1, "vec_id")
    return best.select("vec_id", F.round("score", 6).alias("score"))


_PAIRS = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), "
    "u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v), "
    "p AS (SELECT q.vec_id AS question, u.vec_id, round(list_sum(list_transform(range(1, len(q.e) + 1), "
    "lambda i: q.e[i] * u.e[i])), 12) AS score FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % {every} = 0) "
)


@query(
    "dense_retrieval_many",
    _PAIRS.format(every=20)
    + "SELECT question, vec_id, CAST(rank AS INT) AS rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY question ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10",
)
def dense_retrieval_many(spark, sf):
    """The ten vectors most like each question of a table."""
    vectors = C.table(spark, sf, "embeddings")
    found = retrieval.nearest(vectors.where("vec_id % 20 = 0"), vectors, 10)
    return found.withColumn("score", F.round("score", 9))


@query(
    "answers_reused",
    _PAIRS.format(every=1)
    + "SELECT question, vec_id, CAST(1 AS INT) AS rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY question ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank = 1 AND score >= 0.3",
)
def answers_reused(spark, sf):
    """For every question of the table the most similar other one, if it is similar enough."""
    vectors = C.table(spark, sf, "embeddings")
    found = retrieval.nearest(vectors, vectors, 1, least=0.3)
    return found.withColumn("score", F.round("score", 9))


@query(
    "lexical_retrieval_many",
    "WITH q AS (SELECT item_id AS question, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term "
    "FROM benchmark), w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), "
    "s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w), "
    "t AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY ALL), "
    "f AS (SELECT term, count(*) AS df FROM t GROUP BY term), "
    "r AS (SELECT question, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / "
    "(tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY ALL) "
    "SELECT question, doc, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY question ORDER BY score DESC, doc) AS rank FROM r) WHERE rank <= 10",
)
def lexical_retrieval_many(spark, sf):
    """The ten best documents for each of many questions, from a written index."""
    path = fresh_path(spark, "index")
    retrieval.write_index(C.table(spark, sf, "documents"), path)
    words = F.regexp_extract_all(F.lower("text"), F.lit(retrieval.TOKEN), F.lit(0))
    asked = C.table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), words.alias("terms"))
    return retrieval.bm25_many(asked, path).withColumn("score", F.round("score", 6))
