"""SQL that gives the rows of the training-data queries, where SQL can."""

from __future__ import annotations

# CRC-32 of UTF-8 text, from its polynomial; crc(hex digits of the bytes).
_CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i::BIGINT, range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def crc32(text: str) -> str:
    """CRC-32 of a string expression; crc_table must be joined."""
    digit = "strpos('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1"
    byte = f"16 * ({digit.format(text, '2 * i + 1')}) + {digit.format(text, '2 * i + 2')}"
    steps = f"list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})), lambda i: ({byte})::BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS marked, run, count(*) AS n
  FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
),
hashed AS (SELECT run, n, {crc32("marked")} AS h FROM counted, crc_table),
damaged AS (
  SELECT CASE WHEN h % 199 = 0
    THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed
),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cut AS (SELECT word, n, i, left(word, i::INT) AS a, substr(word, i::INT + 2) AS b FROM places),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.a || c.b = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.a || c.b = w.word
),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, max(m) AS m,
    min(CASE WHEN m = top THEN other END) AS other
  FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word
),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.m >= 5 * w.n THEN b.other END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
),
ways(word, reached) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.reached WHERE forms.form IS NOT NULL
)
SELECT f.word, f.form, ways.reached AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN ways ON ways.word = f.word JOIN forms e ON e.word = ways.reached AND e.form IS NULL
"""



def _taken(state: str, cost: str, edit: str, row: str = "''", where: str = "true") -> str:
    """One way on from a state: cost so far, audit, repaired rows; null where there is none."""
    step = f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {state}.o || {row}}}"
    return f"CASE WHEN {state} IS NOT NULL AND {where} THEN {step} END"


def _row_taken(to: str) -> str:
    """The lightest way to a state over one row: deleted, kept, or with another role."""
    ways = [_taken(f"w.{to}", "3", "D")]
    whole, said = "f.fault NOT IN ('b', 'd')", r"chr(10) || f.role || ':' || f.text"
    for q in {"e": "", "s": "e", "u": "esa", "a": "u"}[to]:
        ways.append(_taken(f"w.{q}", "f.late", "K", said, f"{whole} AND f.initial = '{to}'"))
        if to != "s":
            role = {"u": "user", "a": "assistant"}[to]
            ways.append(_taken(f"w.{q}", "2 + f.late", "R", f"chr(10) || '{role}:' || f.text", whole))
    return f"list_min([{', '.join(ways)}])"


def _added(q: str, role: str) -> str:
    return _taken(q, "2", "I", f"chr(10) || '{role}:'")


_FROM_NOTHING = "{'c': 0::BIGINT, 'a': '', 'o': ''}"
REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS mark
  FROM conversations
),
chosen AS (SELECT *, {crc32("mark")} % 20 AS way FROM marked, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN way = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM chosen WHERE way <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM damaged
),
faulty AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, CASE WHEN shown = '' THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
),
rated AS (SELECT *, (fault = 't')::BIGINT AS late FROM faulty),
walk(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {_FROM_NOTHING}, CASE WHEN false THEN {_FROM_NOTHING} END,
    {{'c': 2::BIGINT, 'a': 'I', 'o': chr(10) || 'user:'}},
    {{'c': 4::BIGINT, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}}
  FROM (SELECT DISTINCT conv_id FROM rated)
  UNION ALL
  SELECT conv_id, i, e, s, u, list_min([a, {_added("u", "assistant")}]) FROM (
    SELECT conv_id, i, e, s, a, list_min([u, {_added("e", "user")}, {_added("s", "user")}, {_added("a", "user")}]) AS u
    FROM (
      SELECT w.conv_id, f.i, {_row_taken("e")} AS e, {_row_taken("s")} AS s, {_row_taken("u")} AS u, {_row_taken("a")} AS a
      FROM walk w JOIN rated f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    )
  )
),
goals AS (
  SELECT conv_id, list_min([e, a]) AS best FROM walk
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rated GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN goals g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE: dict[str, str] = {"op11_spelling": SPELLING, "op12_repair": REPAIR}
