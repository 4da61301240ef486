"""Parts of the oracle queries: the same results in plain SQL, worked out another way.

The dialect has no lookbehind and only ASCII word edges, so a keyword before a
number, or the edge before a Cyrillic letter, is matched and a group is taken;
the group always ends the match.
"""

from __future__ import annotations

from veilframe.operators import patterns as P

_EDGE = r"(?:^|[^\p{L}\p{N}_])"


def _body(ty: str) -> str:
    return P.BY_TYPE[ty].regex.replace(r"(?=\d)", "").replace("(?=4)", "").replace("(?=0)", "")


def regex(ty: str) -> tuple[str, int]:
    """The pattern in the oracle's dialect, and which group is the value."""
    special = {
        "INN_RU": (r"(?:ИНН(?:\s№\s|\s№|№|:\s|:|\s)|INN(?:\s|:\s|:))(\d{10}(?:\d{2})?)\b", 1),
        "SNILS_RU": (r"\b\d{3}[-\s.]?\d{3}[-\s.]?\d{3}[-\s.]?\d{2}\b", 0),
        "KPP_RU": (r"КПП(?:\s|:\s|:)(\d{9})\b", 1),
        "PHONE_RU": (
            r"(?:\+7|8)[-\s]?\(?\d{3}\)?[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b", 0,
        ),
        "OMS_RU": (r"(?:ОМС|полис|страхов)[:\s№]*?\d{16}", 0),
        "EMAIL_ADDRESS": (
            r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}", 0,
        ),
    }
    if ty in special:
        body, group = special[ty]
        return "(?i)" + body, group
    body = _body(ty)
    if ty in ("ADDRESS_RU", "VEHICLE_PRIVATE_RU", "VEHICLE_TAXI_BUS_RU", "VEHICLE_TRAILER_RU", "VIN"):
        assert body.startswith(r"\b")
        return f"(?i){_EDGE}({body[2:]})", 1
    return "(?i)" + body, 0


def luhn(value: str) -> str:
    digits = f"reverse(regexp_replace({value}, '[^0-9]', '', 'g'))"
    total = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 "
        f"THEN CAST(substr({digits}, CAST(i AS INT), 1) AS INT) "
        f"ELSE (CAST(substr({digits}, CAST(i AS INT), 1) AS INT) * 2) // 10 "
        f"+ (CAST(substr({digits}, CAST(i AS INT), 1) AS INT) * 2) % 10 END))"
    )
    return f"(length({digits}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def matches(source: str, ty: str, keys: str) -> str:
    """SELECT keys, text, st, ln, v of one pattern over a source with ``text``."""
    pattern, group = regex(ty)
    where = f"WHERE {luhn('v')}" if ty in P._CHECKSUM else ""
    return (
        f"SELECT * FROM (SELECT {keys}, text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) "
        "+ coalesce(list_sum(list_transform(m0[1:i-1], lambda x: length(x))), 0) "
        "+ length(m0[i]) - length(m1[i]) AS INT) AS st, CAST(length(m1[i]) AS INT) AS ln, m1[i] AS v "
        f"FROM (SELECT {keys}, text, regexp_extract_all(text, '{pattern}', 0) AS m0, "
        f"regexp_extract_all(text, '{pattern}', {group}) AS m1, "
        f"string_split_regex(text, '{pattern}') AS g, "
        f"unnest(range(1, len(regexp_extract_all(text, '{pattern}', 0)) + 1)) AS i "
        f"FROM ({source}))) {where}"
    )


KEYS = "group_id, doc_seq, unit_no"


def spans(source: str, types: list[str], keys: str = KEYS) -> str:
    """SELECT keys, text, st, ln, pr, ty, v of several patterns, overlaps included."""
    return " UNION ALL ".join(
        f"SELECT {keys}, text, st, ln, {P.BY_TYPE[ty].rank} AS pr, '{ty}' AS ty, v "
        f"FROM ({matches(source, ty, keys)})"
        for ty in types
    )


def resolved(source: str, types: list[str], keys: str = KEYS) -> str:
    """The same without overlaps, longest first."""
    items = (
        f"SELECT {keys}, any_value(text) AS text, list_sort(list({{'nl': -ln, 'st': st, 'pr': pr, "
        f"'ty': ty, 'v': v}})) AS l FROM ({spans(source, types, keys)}) GROUP BY {keys}"
    )
    kept = (
        f"SELECT {keys}, text, unnest(list_reduce(l[2:], lambda acc, x: CASE WHEN len(list_filter(acc, "
        "lambda k: greatest(k.st, x.st) < least(k.st - k.nl, x.st - x.nl))) > 0 THEN acc "
        f"ELSE list_append(acc, x) END, l[1:1])) AS s FROM ({items})"
    )
    return f"SELECT {keys}, text, s.st AS st, -s.nl AS ln, s.ty AS ty, s.v AS v FROM ({kept})"


RU_TYPES = [p.ty for p in P.RU]
IN_TYPES = [p.ty for p in P.IN]


def found(source: str, types: list[str]) -> str:
    """Both passes: pattern spans, then e-mail addresses beside them."""
    first = resolved(source, types)
    mail = matches(source, "EMAIL_ADDRESS", KEYS)
    free = (
        f"SELECT m.* FROM ({mail}) m WHERE NOT EXISTS (SELECT 1 FROM ({first}) f "
        "WHERE f.group_id = m.group_id AND f.doc_seq = m.doc_seq AND f.unit_no = m.unit_no "
        "AND greatest(f.st, m.st) < least(f.st + f.ln, m.st + m.ln))"
    )
    return (
        f"SELECT {KEYS}, text, 1 AS pass, st, ln, ty, v, lower(trim(v)) AS norm FROM ({first}) UNION ALL "
        f"SELECT {KEYS}, text, 2, st, ln, 'EMAIL_ADDRESS', v, lower(trim(v)) FROM ({free})"
    )


def entities(source: str, types: list[str]) -> str:
    """group_id, norm, ty, original, n, token of every distinct value."""
    order = "{'a': doc_seq, 'u': unit_no, 'p': pass, 'n': -st}"
    first = (
        f"SELECT group_id, norm, arg_min(ty, {order}) AS ty, arg_min(v, {order}) AS original, "
        f"min({order}) AS o FROM ({found(source, types)}) GROUP BY group_id, norm"
    )
    return (
        "SELECT *, '<' || ty || '_' || n || '>' AS token FROM (SELECT group_id, norm, ty, original, "
        f"row_number() OVER (PARTITION BY group_id, ty ORDER BY o) AS n, o FROM ({first}))"
    )


def masked(source: str, types: list[str]) -> str:
    """KEYS, masked_text, spans_found, map_size of every text."""
    return (
        f"WITH src AS ({source}), fnd AS MATERIALIZED ({found('SELECT * FROM src', types)}), "
        f"ent AS MATERIALIZED ({entities('SELECT * FROM src', types)}), "
        "cut AS (SELECT fnd.*, token, coalesce(lag(st + ln) OVER w, 0) AS before, "
        "row_number() OVER (PARTITION BY fnd.group_id, doc_seq, unit_no ORDER BY st DESC) AS back "
        "FROM fnd JOIN ent ON fnd.group_id = ent.group_id AND fnd.norm = ent.norm "
        "WINDOW w AS (PARTITION BY fnd.group_id, doc_seq, unit_no ORDER BY st)), "
        "done AS (SELECT group_id, doc_seq, unit_no, "
        "string_agg(substr(text, before + 1, st - before) || token || "
        "CASE WHEN back = 1 THEN substr(text, st + ln + 1) ELSE '' END, '' ORDER BY st) AS t, "
        "count(*) AS c, count(DISTINCT token) AS d FROM cut GROUP BY ALL) "
        "SELECT src.group_id, src.doc_seq, src.unit_no, coalesce(t, text) AS masked_text, "
        "CAST(coalesce(c, 0) AS INT) AS spans_found, CAST(coalesce(d, 0) AS INT) AS map_size "
        "FROM src LEFT JOIN done ON src.group_id = done.group_id AND src.doc_seq = done.doc_seq "
        "AND src.unit_no = done.unit_no"
    )
